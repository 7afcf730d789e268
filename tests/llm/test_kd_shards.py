from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from __spark_entry__ import queries
from diamondframe.llm.common import id_key
from diamondframe.llm.kd_shards import kd_shards

from llm.brute import COLUMNS, edge_table


def check(rows, got, n_shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < n_shards for s in slots)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(n_shards)]
    return sizes


def log2(x: float) -> float:
    return math.log(x) / math.log(2)


def tree(rows, n_shards) -> Counter:
    """(doc_id, text) to shards, by a k-d tree on sorted rows; the keys as the module states them."""
    points = []
    for (i, t), h in rows:
        data, t = (t or "").encode(), t or ""
        crc = zlib.crc32(data)
        measured = (
            log2(len(data) + 1), len(data) / max(1, len(t)),
            log2(len(t) / (t.count("\n") + 1) + 1), log2(len(t) / (t.count(" ") + 1) + 1),
        )
        points.append((measured, crc << 16 | h % 65536, len(data) + 1, i, t))
    lo, hi = ([f(p[0][d] for p in points) for d in range(4)] for f in (min, max))
    part = lambda x, d: int((x - lo[d]) / (hi[d] - lo[d]) * 32767) if hi[d] > lo[d] else 0
    points = [(tuple(part(x, d) for d, x in enumerate(m)), tie, *rest) for m, tie, *rest in points]
    out = Counter()

    def split(own, first, shards):
        if shards == 1 or not own:
            out.update((i, t, first) for *_, i, t in own)
            return
        spread = [len(own) * sum(p[0][d] ** 2 for p in own) - sum(p[0][d] for p in own) ** 2 for d in range(4)]
        widest = spread.index(max(spread))
        key = lambda p: p[0][widest] << 48 | p[1]
        wanted, groups = sum(p[2] for p in own) * (shards // 2) / shards, defaultdict(list)
        for p in own:
            groups[key(p)].append(p)
        left, right = [], []
        for k in sorted(groups):
            size = sum(p[2] for p in groups[k])
            if not right and (wanted > size or 2 * wanted >= size) and wanted > 0:
                left += groups[k]
                if wanted <= size:
                    wanted = 0
                else:
                    wanted -= size
            else:
                wanted = 0
                right += groups[k]
        split(left, first, shards // 2)
        split(right, first + shards // 2, shards - shards // 2)

    split(points, 0, n_shards)
    return out


@pytest.mark.parametrize("n_shards", [2, 5, 16])
def test_against_a_tree_on_sorted_rows(spark, n_shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hashed = docs.select("doc_id", "text", F.xxhash64(id_key()).alias("h")).collect()
    want = tree([((r.doc_id, r.text), r.h) for r in hashed], n_shards)
    texts = {r.doc_id: r.text or "" for r in hashed}
    got = Counter((r.doc_id, texts[r.doc_id], r.shard) for r in kd_shards(docs, n_shards).collect())
    assert got == want


def test_edges_against_a_tree(spark, edge_docs):
    hashed = edge_docs.select("doc_id", "text", F.xxhash64(id_key()).alias("h")).collect()
    want = Counter((i, s) for (i, _, s), n in tree([((r.doc_id, r.text), r.h) for r in hashed], 4).items() for _ in range(n))
    assert Counter((r.doc_id, r.shard) for r in kd_shards(edge_docs, 4).collect()) == want


def test_shards_have_near_equal_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [r.asDict() for r in queries()["op9_kd_shards"](spark, SF).collect()]
    sizes = check([(r.doc_id, r.text) for r in docs], got, 16)
    largest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= largest
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


@pytest.mark.parametrize("n_shards", [1, 3, 16])
def test_edges(edge_docs, n_shards):
    check(edge_table(), [r.asDict() for r in kd_shards(edge_docs, n_shards).collect()], n_shards)


def test_target_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = kd_shards(docs, None, 200_000).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == -(-sum(sizes.values()) // 200_000) and max(sizes.values()) < 240_000


def test_many_leaves(spark):
    rows = [(i, f"text {i} " * (i % 23 + 1), None, None, 0, 0, "", 0, "", "") for i in range(1500)]
    got = [r.asDict() for r in kd_shards(spark.createDataFrame(rows, COLUMNS), None, 2000).collect()]
    sizes = check([(r[0], r[1]) for r in rows], got, 1 + max(r["shard"] for r in got))
    assert len(sizes) == -(-sum(sizes) // 2000) > 80
    assert max(sizes) < 2000 + max(r["size"] for r in got)


def test_a_group_of_copies_is_split_only_where_it_must(spark):
    rows = [(i, "the same text " * 9 if i % 3 == 0 else f"text {i} " * (i % 17), None, None, 0, 0, "", 0, "", "")
            for i in range(3000)]
    got = [r.asDict() for r in kd_shards(spark.createDataFrame(rows, COLUMNS), 8).collect()]
    sizes = check([(r[0], r[1]) for r in rows], got, 8)
    assert max(sizes) <= 1.1 * min(sizes)
    places = defaultdict(set)
    for r in got:
        places[r["text_crc32"]].add(r["shard"])
    split = [k for k, v in places.items() if len(v) > 1]
    assert len(split) <= 7


def test_empty_table(no_docs):
    assert kd_shards(no_docs).collect() == []
