from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF, SMALL
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from compare import compare, duckdb_over
from diamondframe.llm import prefix_trie as T
from diamondframe.session import written

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos string, conv int, n_turns int"
NAME = "op12_prefix_trie"


def rebuilt(rows: list[tuple]) -> dict[int, tuple]:
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(found)] for c, found in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(math.fmod(c, 100))  # as SQL takes a remainder
        out[c] = tuple(turns.get(first, [])[:h] + mine[h:])
    return out


def trie(paths: dict[int, tuple]) -> Counter:
    """Every node, by going over its members."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, below = Counter(), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        saved = (len(own) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += not children[node]
            below[node[:d]][1] += saved
    out = Counter()
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[(min(own), len(node), parent, len(own), children[node], *below[node],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def checked(spark, rows: list[tuple], partitions: int = 3) -> None:
    table = [(*r, 1, "x", 2, 3) for r in rows]
    df = spark.createDataFrame(table, SCHEMA).repartition(partitions)
    got = T.prefix_trie(*T.rebuilt(T.ordered_turns(df))).drop("ka", "kb").collect()
    assert Counter(tuple(r) for r in got) == trie(rebuilt(rows))


def test_equals_its_sql(spark):
    found = compare(spark, duckdb_over(SF), queries()[NAME], oracle_sql()[NAME], SF)
    assert found["types"] is True and found["equal"] and found["rows"][0] > 0, found


def test_all_conversations_against_their_members(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()[NAME](spark, SMALL).collect()
    assert Counter(tuple(r) for r in got) == trie(rebuilt(rows))


def test_shared_openings_copies_and_gaps(spark):
    made, rows = random.Random(2), []
    # Families with and without a first conversation; many equal turns, copies, single turns.
    for c in [*range(0, 12), *range(100, 105), 207, 208, 299, -100, -130, -7]:
        for n in range(made.choice([1, 2, 3, 6, 7, 9])):
            rows.append((c, n * 3, made.choice(["user", "bot"]), made.choice(["yes", "no", "hello there"])))
    for c in range(301, 340):
        rows += [(c, 1, "user", "the same"), (c, 2, "bot", "answer")]
    checked(spark, rows)


def test_edges(spark):
    rows = [
        (None, 1, "user", "nobody's"), (None, None, None, None), (1, None, "user", "first"), (1, -5, "user", "second"),
        (1, 0, None, None), (1, 1, "", ""), (2, 5, "user", "x" * 100_000), (3, 5, "user", "x" * 100_000),
        (4, 1, "user", "twice"), (4, 1, "user", "twice"), (5, 1, "user", "Äé💡"), (100, 7, None, "only"),
        (101, 7, "user", None), (2**62, 1, "user", "far"), (-(2**62), 1, "user", "far"),
    ]
    checked(spark, rows)
    checked(spark, rows, 1)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "nobody's", 1, "x", 2, 3)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert T.prefix_trie(*T.rebuilt(T.ordered_turns(df))).collect() == []


@pytest.mark.parametrize("chunk", [2, 1024])
def test_long_conversations_go_on_in_further_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(T, "CHUNK_BLOCKS", chunk)
    monkeypatch.setattr(T, "CHUNK_IDS", 3)
    line = [("user", f"turn {k % 7}") for k in range(70)]
    rows = [(c, k, *line[k]) for c in range(401, 409) for k in range(c % 5 * 8 + 30)]
    rows += [(c, k, *line[k % 3]) for c in range(409, 412) for k in range(c - 400)]
    rows += [(c, k, *(line[k] if k < 40 else ("user", f"own {c}"))) for c in (412, 413) for k in range(64)]
    checked(spark, rows)


def test_turns_with_equal_numbers_have_one_order(spark):
    rows = [(c, 1, "user", t, 1, "x", 2, 3) for c in (1, 2) for t in ("b", "a", "c")]
    found = []
    for table in (rows, rows[::-1]):
        turns = written(T.ordered_turns(spark.createDataFrame(table, SCHEMA)), "equal-numbers")
        found.append(sorted(tuple(r) for r in turns.select("conv", "pos", "a").collect()))
        by_conv = turns.groupBy("a").agg(F.collect_set("pos").alias("places")).collect()
        assert all(len(r.places) == 1 for r in by_conv)
    assert found[0] == found[1]
