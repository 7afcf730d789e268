"""Centroid clustering of integer vectors by scalar lookup tables.

The vectors are put into blocks once: for each dimension of a block the occurring integers in
order, and for each vector their numbers. A round never subtracts a centroid from a vector. For
each dimension it tabulates the squared difference of every occurring integer to every centroid;
a vector's distances are the table rows of its numbers, gathered and summed. Component sums come
from counts of (cluster, number) and the occurring integers.

A round is one job over the written blocks, with the centroids in its closure. A task hands on
one row per cluster; the driver holds clusters x dimensions numbers, whatever the table's size.
All arithmetic is exact, so the result does not hang on the partitioning. A table of a dimension
has at most as many rows as a block has vectors.

Defined results: vectors that are null, of another length, or with a null, NaN, infinite or
huge component (|x| above 2^17, whose squares would not fit a long) are not kept and have no
row; a missing vec_id is an empty one in the hash and null in the result; rows with equal vec_id
are vectors of their own, in the order of their components where the hash ties; with fewer kept
vectors than clusters each is a centroid; an empty table gives an empty table; only vec_id and
embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from diamondframe.llm.common import read_table
from diamondframe.session import written

COMPONENTS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Vectors of a block; the numbers of their integers fit two bytes.
BLOCK_ROWS = 4096
#: The largest integer: 64 squares of twice as much fit a long.
LARGEST = 1 << 27
_BLOCKS = "vec_ids array<long>, sizes array<int>, occurring array<long>, codes binary"


def _integers(embedding: pa.Array, components: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their components as integers."""
    lengths = pc.fill_null(pc.list_value_length(embedding), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == components)
    # A null component becomes NaN here and goes with the others.
    flat = embedding.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    found = np.floor(flat.astype(np.float64).reshape(-1, components) * scale)
    with np.errstate(invalid="ignore"):
        good = (np.abs(found) <= LARGEST).all(axis=1)
    return right[good], found[good].astype(np.int64)


def vector_blocks(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The kept vectors in blocks: ids, occurring integers per dimension, numbers per vector."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = _integers(batch.column(1), components, scale)
            ids = batch.column(0).take(pa.array(kept))
            for at in range(0, len(kept), BLOCK_ROWS):
                block = found[at : at + BLOCK_ROWS]
                split = [np.unique(block[:, d], return_inverse=True) for d in range(components)]
                codes = np.stack([code for _, code in split]).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({
                    "vec_ids": pa.array([ids[at : at + BLOCK_ROWS].to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(own) for own, _ in split]], pa.list_(pa.int32())),
                    "occurring": pa.array([np.concatenate([own for own, _ in split])], pa.list_(pa.int64())),
                    "codes": pa.array([codes.tobytes()], pa.binary()),
                })

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(encode, _BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, np.ndarray]]:
    """For each block its ids, the occurring integers of each dimension, and the numbers."""
    for batch in batches:
        for ids, sizes, occurring, codes in zip(*batch.columns):
            edges = np.cumsum(sizes.values.to_numpy())[:-1]
            numbers = np.frombuffer(codes.as_buffer(), np.uint16).reshape(len(edges) + 1, -1)
            yield ids.values, np.split(occurring.values.to_numpy(), edges), numbers


def table_distances(occurring: list, numbers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of a block's vectors (rows) to the centroids (columns)."""
    total = np.zeros((numbers.shape[1], len(centroids)), dtype=np.int64)
    for d, own in enumerate(occurring):
        table = (own[:, None] - centroids[None, :, d]) ** 2
        total += table[numbers[d]]
    return total


def _round(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Per non-empty cluster: vectors, summed distance and summed components, exactly."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, parts = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, occurring, numbers in _blocks(batches):
            distance = table_distances(occurring, numbers, centroids)
            nearest = distance.argmin(axis=1)  # the first of equals
            n += np.bincount(nearest, minlength=k)
            np.add.at(far, nearest, distance.min(axis=1))
            for d, own in enumerate(occurring):
                pairs = np.bincount(nearest * len(own) + numbers[d], minlength=k * len(own))
                parts[:, d] += pairs.reshape(k, len(own)) @ own
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "far": pa.array(far[some]),
            "parts": pa.array(list(parts[some]), pa.list_(pa.int64())),
        })

    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = blocks.mapInArrow(sums, "cluster int, n long, far long, parts array<long>")
    found = rows.groupBy("cluster").agg(
        F.sum("n"), whole(F.col("far")), *[whole(F.get("parts", F.lit(d))) for d in range(width)]
    ).collect()
    return {r[0]: (r[1], int(r[2]), [int(x) for x in r[3:]]) for r in found}


def first_centroids(blocks: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt:vec_id``, in ascending order of the hash."""
    components = len((blocks.first() or [None, []])[1])
    if not components:
        return np.zeros((0, 0), dtype=np.int64)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, occurring, numbers in _blocks(batches):
            digests = [hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
            # A block's own candidates; the order of the rest follows below.
            order = sorted(range(len(digests)), key=digests.__getitem__)
            last = digests[order[min(clusters, len(order)) - 1]]
            some = [i for i in order if digests[i] <= last]
            found = np.stack([own[numbers[d][some]] for d, own in enumerate(occurring)], axis=1)
            yield pa.RecordBatch.from_pydict({
                "digest": pa.array([digests[i] for i in some]),
                "vector": pa.array(list(found), pa.list_(pa.int64())),
            })

    found = blocks.mapInArrow(unpack, "digest string, vector array<long>")
    chosen = found.orderBy("digest", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in chosen], dtype=np.int64)


def centroid_clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
    components: int = COMPONENTS, scale: int = SCALE, salt: str = SALT,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia and inertia of every kept vector; the centroids.

    Components are multiplied by ``scale`` and floored. After ``rounds`` rounds the vectors are
    assigned once more.
    """
    blocks = written(vector_blocks(vectors, components, scale), "vector-blocks")
    centroids = first_centroids(blocks, clusters, salt)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (n, _, parts) in _round(blocks, centroids).items():
            centroids[cluster] = [x // n for x in parts]
    inertia = {c: far for c, (_, far, _) in _round(blocks, centroids).items()} if len(centroids) else {}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, occurring, numbers in _blocks(batches):
            distance = table_distances(occurring, numbers, centroids)
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids, "cluster": pa.array(distance.argmin(axis=1), pa.int32()),
                "distance": pa.array(distance.min(axis=1)),
            })

    assigned = blocks.mapInArrow(assign, "vec_id long, cluster int, distance long")
    return assigned.select(
        "*", _of_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
    ), centroids


def _of_cluster(values: dict, kind: str) -> Column:
    """The value of the row's cluster, from at most as many as there are clusters."""
    names = sorted(values)
    listed = F.array(*[F.lit(values.get(c)).cast(kind) for c in range(names[-1] + 1 if names else 0)])
    return F.get(listed.cast(f"array<{kind}>"), F.col("cluster"))


def op13_centroid_clustering(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, centroids = centroid_clusters(vectors)
    digests = {c: hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for c, x in enumerate(centroids)}
    return found.withColumn("centroid_sha256", _of_cluster(digests, "string"))


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}


def _oracle() -> str:
    """Ten rounds, one after the other."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assign = f"""
      SELECT k.row, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v,
             arg_min(c.cluster, {square} * 100 + c.cluster) AS cluster,
             min({square}) AS distance
      FROM kept k, centroids_{{n}} c GROUP BY k.row"""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), centroids_0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1)::INT AS cluster, v
  FROM kept ORDER BY sha256('{SALT}:' || vec_id) LIMIT {CLUSTERS}
), assigned_0 AS MATERIALIZED ({assign.format(n=0)})"""]
    for n in range(1, ROUNDS + 1):
        steps.append(f"""
summed_{n} AS (
  SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM assigned_{n - 1}
  ) GROUP BY cluster, pos
), centroids_{n} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.v, o.v) AS v FROM centroids_{n - 1} o LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM summed_{n} GROUP BY cluster
  ) m ON o.cluster = m.cluster
), assigned_{n} AS MATERIALIZED ({assign.format(n=n)})""")
    return f"""
WITH {",".join(steps)}
SELECT a.vec_id, a.cluster, a.distance::BIGINT AS distance,
       (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM assigned_{ROUNDS} a JOIN centroids_{ROUNDS} c ON a.cluster = c.cluster
"""


ORACLES = {"op13_centroid_clustering": _oracle()}
