from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from diamondframe.operators import ordered
from diamondframe.operators.ordered import lead_in_order, number_in_order


def skewed_rows(seed: int, n: int = 3000) -> list[tuple]:
    """A third in one game, a sixth without a game, some without an at-bat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        share = rng.random()
        game = 5 if share < 1 / 3 else None if share < 1 / 2 else rng.randrange(40)
        at_bat = None if rng.random() < 0.05 else rng.randrange(600 if game == 5 else 20)
        rows.append((i, game, at_bat, rng.randrange(4), rng.choice("xyz")))
    return rows


SCHEMA = "id long, game long, at_bat long, pitch long, state string"
ORDER = ["game", "at_bat", "pitch", "id"]


def last_first(value):
    return (value is None, value or 0)


def in_order(rows):
    return sorted(rows, key=lambda r: (last_first(r[1]), last_first(r[2]), r[3], r[0]))


@pytest.fixture(params=[1, 31, 200])
def ranges(request, spark):
    """The number of ranges; not to be made fewer."""
    keys = {"spark.sql.shuffle.partitions": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lead_over_the_whole_table(spark, ranges):
    rows = skewed_rows(ranges)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    led = lead_in_order(df, ORDER, {"nxt": "state", "nxt_id": "id"})
    want = in_order(rows)
    following = {a[0]: (b[4], b[0]) for a, b in zip(want, want[1:])}
    following[want[-1][0]] = (None, None)
    got = {r.id: (r.nxt, r.nxt_id) for r in led.collect()}
    assert got == following


def test_lead_carries_a_null_value_of_the_next_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "g long, p long, s string")
    led = lead_in_order(df, ["g", "p"], {"nxt": "s"})
    assert {(r.g, r.p): r.nxt for r in led.collect()} == {(1, 1): None, (1, 2): "b", (2, 1): None}


def test_row_number_within_partitions(spark, ranges):
    rows = skewed_rows(9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    numbered = number_in_order(
        df, ["game"], ["at_bat", "pitch", "id"], "n", lowest={"low": "id"},
    )
    want, low, seen = {}, {}, {}
    for row in in_order(rows):
        seen[row[1]] = seen.get(row[1], 0) + 1
        want[row[0]] = seen[row[1]]
        low[row[1]] = min(low.get(row[1], row[0]), row[0])
    got = numbered.collect()
    assert {r.id: r.n for r in got} == want
    assert all(r.low == low[r.game] for r in got)


def test_lowest_is_null_when_a_value_is_missing(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (2, 1, 3)], "g long, p long, v long")
    numbered = number_in_order(df, ["g"], ["p"], "n", lowest={"low": "v"})
    assert {(r.g, r.low) for r in numbered.collect()} == {(1, None), (2, 3)}


def test_ranges_are_balanced_whatever_the_keys(spark, ranges):
    """Nine tenths of the rows without a game, and many of them equal in the whole order."""
    rows = [(i % 50, None, None, 1, "x" + str(i)) for i in range(9000)] + skewed_rows(1, 1000)
    df = spark.createDataFrame(rows, SCHEMA)
    dealt, _ = ordered._in_ranges(df, ORDER)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == ranges
    assert max(sizes) <= 3 * 10_000 / ranges
    numbered = number_in_order(df, ["game"], ["at_bat", "pitch", "id"], "n")
    lone = sorted(r.n for r in numbered.filter("game is null").collect())
    assert lone == list(range(1, len(lone) + 1))


def test_no_window_over_all_rows(spark):
    df = spark.createDataFrame(skewed_rows(2), SCHEMA)
    led = lead_in_order(df, ORDER, {"nxt": "state"})
    plan = led._jdf.queryExecution().executedPlan().toString()
    # Only the table with one row per range is ever in one partition.
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(single) == 1
    whole = df.withColumn("nxt", F.lead("state").over(Window.orderBy(*ORDER)))
    assert "SinglePartition" in whole._jdf.queryExecution().executedPlan().toString()
