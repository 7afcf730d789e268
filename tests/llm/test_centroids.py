from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from __spark_entry__ import oracle_sql, queries
from compare import compare, duckdb_over
from diamondframe.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, codes string"


def plain(rows: list[tuple], clusters: int, rounds: int, width: int):
    """Sorted (vec_id, cluster, distance), and the centroids, without tables."""
    kept = [
        (i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted((digest(i), v) for i, v in kept)[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
            out.append((i, v, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centers)):
            own = [v for _, v, k, _ in found if k == c]
            if own:
                centers[c] = tuple(sum(x) // len(own) for x in zip(*own))
    return Counter((i, c, d) for i, _, c, d in assign()), centers


def made(seed: int, n: int, width: int, spread: float = 1.0) -> list[tuple]:
    random.seed(seed)
    rows = [(i, [float(np.float32(random.gauss(i % 3, spread))) for _ in range(width)]) for i in range(n)]
    return rows


def checked(spark, rows, clusters=4, rounds=5, width=5, partitions=3):
    table = [(i, v, 1, 9, "x", "y") for i, v in rows]
    df = spark.createDataFrame(table, SCHEMA).repartition(partitions)
    found, centers = C.centroid_clusters(df, clusters, rounds, width)
    want, plain_centers = plain(rows, clusters, rounds, width)
    got = found.collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert [tuple(c) for c in centers.tolist()] == plain_centers
    sums = Counter()
    for r in got:
        sums[r.cluster] += r.distance
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
    return got


def test_equals_its_sql(spark):
    name = "op13_centroid_clustering"
    found = compare(spark, duckdb_over(SF), queries()[name], oracle_sql()[name], SF)
    assert found["types"] is True and found["equal"] and found["rows"][0] > 0, found


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_plain_rounds(spark, partitions, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)  # in this process: as many rows as a batch has at most
    assert len(checked(spark, made(1, 150, 5), partitions=partitions)) == 150


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(2, 20, 5) + [
        (100, None), (101, []), (102, [1.0] * 4), (103, [1.0] * 6), (104, [1.0, None, 1.0, 1.0, 1.0]),
        (105, [nan, 1.0, 1.0, 1.0, 1.0]), (106, [inf, 1.0, 1.0, 1.0, 1.0]), (107, [-inf] + [0.0] * 4),
        (108, [1e30] + [0.0] * 4), (109, [-100000.0] * 5), (110, [0.0] * 5), (111, [-0.0] * 5),
        (None, [0.5] * 5), (None, [0.25] * 5), (7, [2.0] * 5), (7, [2.0] * 5), (7, [3.0] * 5),
    ]
    got = checked(spark, rows, clusters=6)
    assert {r.vec_id for r in got}.isdisjoint(range(100, 109))


def test_copies_of_one_vector_and_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(60, [1.0, 2.5]), (61, [3.0, 2.0])]
    checked(spark, rows, clusters=4, width=2)


def test_fewer_vectors_than_clusters_and_none(spark):
    checked(spark, made(3, 2, 5), clusters=8)
    checked(spark, [(1, None)], clusters=8)
    empty, centers = C.centroid_clusters(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and len(centers) == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_tables_hold_every_difference_once():
    values = np.array([[1, 5], [1, -7], [3, 5]])
    split = [np.unique(values[:, d], return_inverse=True) for d in range(2)]
    numbers = np.stack([code for _, code in split])
    centers = np.array([[0, 0], [3, 5]])
    got = C.table_distances([own for own, _ in split], numbers, centers)
    assert got.tolist() == [[26, 4], [50, 148], [34, 0]]
