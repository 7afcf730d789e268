from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from diamondframe import constants as K
from diamondframe.functions import draws
from diamondframe.operators import candidates, expected, lookups
from frames import collected

TYPE = "pitch_type_condensed"
MOVES = [f"avg{s}" for s in K.MOVEMENT] + [f"sd{s}" for s in K.MOVEMENT]


def requests(spark, *rows):
    schema = ("request_id long, pitcher long, batter long, outs int, b1 int, b2 int, b3 int, "
              "balls int, strikes int")
    return spark.createDataFrame(list(rows), schema)


def pitcher_table(spark, *rows, sd=0.0):
    schema = f"pitcher long, {TYPE} string, p_throws string, " + ", ".join(
        f"{m} double" for m in MOVES
    )
    return spark.createDataFrame([(*r, *[90.0] * 6, *[sd] * 6) for r in rows], schema)


def hitter_table(spark, *rows):
    schema = (f"batter long, {TYPE} string, p_throws string, stand string, "
              + ", ".join(f"{c} double" for c in K.HITTER_STATS))
    return spark.createDataFrame(list(rows), schema)


def generic_table(spark, *rows):
    schema = (f"stand string, {TYPE} string, p_throws string, "
              + ", ".join(f"{c} double" for c in K.HITTER_STATS))
    return spark.createDataFrame(list(rows), schema)


def test_arsenal_uses_the_hand_stored_first(spark):
    table = pitcher_table(spark, (1, "SL", "L"), (1, "FF", "R"), (1, "CH", "R"), (2, "FF", "L"))
    got = collected(lookups.pitcher_arsenals(table), "pitcher", TYPE)
    assert [(r["pitcher"], r[TYPE], r["p_throws"]) for r in got] == [
        (1, "CH", "R"), (1, "FF", "R"), (2, "FF", "L"),
    ]


def test_last_row_wins(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, 10.0), (1, "a", 3, 30.0), (1, "a", 2, 20.0), (None, "a", 1, None)],
        "k long, t string, row long, v double",
    )
    got = collected(lookups.keyed_lookup(rows, ["k", "t"], ["row"]), "k")
    assert [(r["k"], r["v"]) for r in got] == [(1, 30.0), (None, None)]


def test_rows_that_tie_in_the_order_give_one_whole_row(spark):
    rows = spark.createDataFrame(
        [(1, 5, "x", 1.0), (1, 5, "y", 2.0), (1, 5, "y", 2.0), (1, 4, "z", 3.0), (2, None, "u", 4.0),
         (2, None, "v", 5.0), (3, None, "w", 6.0), (3, 0, "w", 7.0)],
        "k long, row long, s string, v double",
    )
    found = [collected(lookups.keyed_lookup(rows.repartition(n), ["k"], ["row"]), "k") for n in (1, 6)]
    assert found[0] == found[1] and [r["k"] for r in found[0]] == [1, 2, 3]
    assert (found[0][0]["s"], found[0][0]["v"]) in {("x", 1.0), ("y", 2.0)}
    assert found[0][2]["v"] == 7.0
    two = collected(lookups.keyed_lookup(rows, ["k"], ["row", "v"]), "k")
    assert [r["v"] for r in two] == [2.0, 5.0, 7.0]


def test_a_doubled_or_missing_map_key_is_named(spark):
    schema = f"pitcher long, {TYPE} string, avgVelo double"
    doubled = spark.createDataFrame([(1, "FF", 95.0), (1, "FF", 96.0), (2, "FF", 91.0)], schema)
    with pytest.raises(ValueError, match=f"2 rows with pitcher=1, {TYPE}=FF"):
        lookups.profile_map(doubled, ["pitcher"], TYPE)
    missing = spark.createDataFrame([(1, None, 95.0)], schema)
    with pytest.raises(ValueError, match=f"{TYPE}=None"):
        lookups.profile_map(missing, ["pitcher"], TYPE)
    many = spark.createDataFrame([(1, f"T{k}", 95.0) for k in range(5)], schema)
    assert lookups.profile_map(many, ["pitcher"], TYPE).count() == 1
    with pytest.raises(ValueError, match="5 entries for pitcher=1: more than 4"):
        lookups.profile_map(many, ["pitcher"], TYPE, most=4)


def test_profiles_as_a_map(spark):
    rows = spark.createDataFrame(
        [(1, "R", "SL", 80.0), (1, "R", "FF", 95.0), (2, "L", "FF", 91.0)],
        f"pitcher long, p_throws string, {TYPE} string, avgVelo double",
    )
    got = collected(lookups.profile_map(rows, ["pitcher", "p_throws"], TYPE), "pitcher")
    assert got[0]["profiles"] == {"FF": dict(avgVelo=95.0), "SL": dict(avgVelo=80.0)}


def test_sampled_keys_are_distinct_and_repeatable(spark):
    keys = spark.range(1000).select((F.col("id") % 50).alias("k"))
    first = [r.k for r in lookups.sample_keys(keys, "k", 9, 1).collect()]
    again = [r.k for r in lookups.sample_keys(keys.repartition(5), "k", 9, 1).collect()]
    other = [r.k for r in lookups.sample_keys(keys, "k", 9, 2).collect()]
    assert first == again and len(set(first)) == 9 and first != other


def test_first_stored_side_or_right(spark):
    hitters = hitter_table(
        spark,
        (20, "SL", "R", "L", 1.0, 1.0, 1.0, 1.0, 1.0, 3.0),
        (20, "FF", "R", "R", None, 2.0, 2.0, 2.0, 2.0, 4.0),
    )
    generic = generic_table(
        spark, *[(s, t, h, 9.0, 9.0, 9.0, 9.0, 1.5, 3.5)
                 for s in "LR" for t in ("SL", "FF") for h in "LR"],
    )
    rows = candidates.request_types(
        requests(spark, (1, 1, 20, 0, 0, 0, 0, 0, 0), (2, 2, 20, 0, 0, 0, 0, 0, 0)),
        pitcher_table(spark, (1, "FF", "R"), (1, "SL", "R"), (2, "FF", "L")),
    )
    featured = candidates.hitter_features(
        rows, lookups.first_stands(hitters), hitters, generic
    )
    got = {(r["request_id"], r[TYPE]): r for r in featured.collect()}
    # FF is stored first, with the batter on the right; SL is then looked up on the right.
    assert got[1, "FF"]["stand"] == "R" and got[1, "FF"]["avgEV"] is None
    assert got[1, "FF"]["avgLA"] == 2.0
    assert got[1, "SL"]["stand"] == "R" and got[1, "SL"]["avgEV"] == 9.0
    assert got[2, "FF"]["stand"] == "R" and got[2, "FF"]["sz_top"] == 3.5


def test_number_of_candidates_by_type(spark):
    rows = requests(spark, (1, 1, 20, 0, 0, 0, 0, 0, 0)).withColumns(
        {"sz_bot": F.lit(1.5), "sz_top": F.lit(3.5), TYPE: F.explode(F.array(*map(F.lit, ["FF", "SL"])))}
    )
    grid = candidates.candidate_grid(rows)
    counts = {r[TYPE]: r["count"] for r in grid.groupBy(TYPE).count().collect()}
    assert counts == {"FF": 25, "SL": 15}
    assert grid.filter("inZone = 1").groupBy(TYPE).count().filter("count <> 9").collect()[0][TYPE] == "SL"


def test_movement_without_deviation_is_the_mean(spark):
    rows = candidates.request_types(
        requests(spark, (1, 1, 20, 0, 0, 0, 0, 0, 0)), pitcher_table(spark, (1, "FF", "R"))
    )
    drawn = candidates.draw_movement(rows, 1).first()
    assert {drawn[m] for m in K.MOVEMENT.values()} == {90.0}


def test_movement_draws_are_those_of_the_formula_and_hash_a_key_once(spark):
    asked = requests(spark, *[(i, 1, 5, 0, 0, 0, 0, 0, 0) for i in range(40)])
    rows = candidates.request_types(asked, pitcher_table(spark, (1, "FF", "R"), (1, "SL", "R"), sd=2.0))
    drawn = candidates.draw_movement(rows, 3)
    assert drawn.columns == [*rows.columns, *K.MOVEMENT.values()]
    plain = {
        f"plain_{stat}": draws.normal(
            F.col(f"avg{stat}"), F.col(f"sd{stat}"),
            draws.key_hash(3, F.col("request_id"), F.col(TYPE), F.lit(stat)),
        ) for stat in K.MOVEMENT
    }
    for row in drawn.withColumns(plain).collect():
        assert all(row[metric] == row[f"plain_{stat}"] for stat, metric in K.MOVEMENT.items())
    # Written out for every statistic, the draws were a method too long to be compiled.
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_pitcher_without_profile_drops_out(spark):
    rows = candidates.request_types(
        requests(spark, (1, 7, 20, 0, 0, 0, 0, 0, 0)), pitcher_table(spark, (1, "FF", "R"))
    )
    assert rows.count() == 0


LABELS = ["ball", "home_run", "strike"]


def expectancy(spark, leave_out=()):
    states = expected.all_states(spark).filter(~F.col("state").isin(list(leave_out) or [""]))
    return states.select(
        F.col("state").alias("out_base_count_state"),
        (F.col("outs") * 100 + F.col("b1") * 10 + F.col("balls") + F.col("strikes") * 0.1)
        .cast("double").alias("runs_expected"),
    )


def values(spark, **options):
    leave_out = options.pop("leave_out", ())
    table = expected.next_state_values(expectancy(spark, leave_out), LABELS, **options)
    return {r.state: r.next_values for r in table.collect()}


def test_288_states(spark):
    states = [r.state for r in expected.all_states(spark).collect()]
    assert len(set(states)) == 288 and "2_111_32" in states and "0_000_00" in states


def test_next_values(spark):
    got = values(spark)
    assert got["0_000_00"] == [1.0, 0.0, pytest.approx(0.1)]
    assert got["2_000_02"][2] == 0.0  # third out
    assert got["1_000_30"][0] == 110.0  # walk
    assert values(spark, include_event_runs=True)["0_100_00"][1] == 2.0


def test_a_missing_next_state_makes_the_value_missing(spark):
    table = expected.next_state_values(expectancy(spark, ["0_000_10"]), LABELS)
    rows = spark.createDataFrame([(1, "0_000_00", [0.0, 0.5, 0.5]), (2, "0_000_20", [0.2, 0.3, 0.5]),
                                  (3, "9_999_99", [0.2, 0.3, 0.5])],
                                 "request_id long, state string, probs array<double>")
    valued = expected.expected_runs(expected.with_next_values(rows, table), LABELS)
    got = {r.request_id: r.expected_runs for r in valued.collect()}
    assert got[1] is None and got[3] is None
    assert got[2] == pytest.approx(0.2 * 3 + 0.3 * 0 + 0.5 * 2.1)


def candidate_rows(spark, rows):
    schema = (f"request_id long, {TYPE} string, x_idx int, z_idx int, plate_x double, "
              "plate_z double, expected_runs double")
    return spark.createDataFrame(rows, schema)


def test_best_pitch_ties_and_missing_values(spark):
    rows = [
        (1, "SL", 0, 0, 0.0, 0.0, 0.3), (1, "FF", 1, 2, 0.0, 0.0, 0.3),
        (1, "FF", 1, 1, 0.0, 0.0, 0.3 + 1e-13), (1, "FF", 2, 0, 0.0, 0.0, 0.3),
        (1, "CH", 0, 0, 0.0, 0.0, None), (1, "CH", 0, 1, 0.0, 0.0, 0.31),
        (2, "FF", 0, 0, 0.0, 0.0, None),
    ]
    got = expected.best_pitch(candidate_rows(spark, rows).repartition(4)).collect()
    assert [(r.request_id, r[TYPE], r.x_idx, r.z_idx) for r in got] == [(1, "FF", 1, 1)]


def test_best_pitch_is_the_minimum_whatever_the_partitioning(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 40).alias("request_id"),
        F.element_at(F.array(*map(F.lit, K.PITCH_TYPES)), (F.col("id") % 7 + 1).cast("int")).alias(TYPE),
        (F.col("id") % 5).cast("int").alias("x_idx"), (F.col("id") % 3).cast("int").alias("z_idx"),
        F.lit(0.0).alias("plate_x"), F.lit(0.0).alias("plate_z"),
        (F.hash("id") % 1000 / 1000).alias("expected_runs"),
    )
    lowest = {r[0]: r[1] for r in rows.groupBy("request_id").agg(F.min("expected_runs")).collect()}
    one, eight = (
        {r.request_id: r for r in expected.best_pitch(rows.repartition(n)).collect()} for n in (1, 8)
    )
    assert one == eight
    assert {k: r.expected_runs for k, r in one.items()} == lowest


def test_best_pitch_packs_value_type_and_target_in_order(spark):
    """Against a plain sort, with values that differ in the ninth decimal and in the sign."""
    made = spark.range(4000).select(
        (F.col("id") % 97).alias("request_id"),
        F.get(F.array(*[F.lit(t) for t in [*K.PITCH_TYPES, "EP"]]), (F.col("id") % 8).cast("int")).alias(TYPE),
        (F.col("id") * 7 % 5).cast("int").alias("x_idx"), (F.col("id") * 3 % 5).cast("int").alias("z_idx"),
        F.when(F.col("id") % 11 == 0, None).otherwise(((F.col("id") * 31 % 13) - 3) / 1e9 + 0.25 * (F.col("id") % 3)).alias("expected_runs"),
        F.col("id").cast("double").alias("plate_x"), F.lit(1.0).alias("plate_z"),
        F.array(*[F.col("id").cast("double") + k for k in range(10)]).alias("probs"),
    )
    want = {}
    for r in made.collect():
        if r.expected_runs is not None and r[TYPE] != "EP":
            key = (round(r.expected_runs, 9), r[TYPE], r.x_idx, r.z_idx)
            want.setdefault(r.request_id, []).append((key, r.plate_x))
    keep = [TYPE, "x_idx", "z_idx", "plate_x", "expected_runs", "probs"]
    got = expected.best_pitch(made.repartition(5), keep).collect()
    assert len(got) == len(want) == 97
    for r in got:
        least = min(key for key, _ in want[r.request_id])
        assert (round(r.expected_runs, 9), r[TYPE], r.x_idx, r.z_idx) == least
        assert r.plate_x in {p for key, p in want[r.request_id] if key == least}
        assert r.probs == [r.plate_x + k for k in range(10)]
