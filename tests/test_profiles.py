from __future__ import annotations

import statistics

import pytest

from diamondframe.constants import HitterThresholds, PitcherThresholds
from diamondframe.operators import profiles, training
from diamondframe.operators.pitches import labelled_pitches, relevant_pitches
from frames import collected, pitches

NO_HITTER = HitterThresholds(0, 0, 0)
NO_PITCHER = PitcherThresholds(0, 0.0)


def sums(spark, *changes):
    return profiles.hitter_sums(relevant_pitches(pitches(spark, *changes)))


def in_play(n=1, **more):
    return [dict(description="hit_into_play", events="single", launch_speed="100",
                 launch_angle="10", **more)] * n


def test_means_skip_missing_and_unreadable_values(spark):
    table = sums(
        spark, *in_play(), dict(launch_speed="90", launch_angle="x"), dict(launch_speed="NaN")
    )
    row = profiles.generic_hitter_profiles(table).first()
    assert (row.avgEV, row.avgLA) == (95.0, 10.0)


def test_swing_rates_inside_and_outside(spark):
    table = sums(
        spark,
        dict(zone="1", description="foul"), dict(zone="9", description="called_strike"),
        dict(zone="11", description="ball"), dict(zone="12", description="swinging_strike"),
        dict(zone="13", description="ball"), dict(zone=None, description="foul"),
    )
    row = profiles.generic_hitter_profiles(table).first()
    assert row.zSwingPCT == 0.5 and row.oSwingPCT == pytest.approx(1 / 3)


def test_rate_without_pitches_is_null(spark):
    row = profiles.generic_hitter_profiles(sums(spark, dict(zone="1"))).first()
    assert row.oSwingPCT is None and row.zSwingPCT == 0.0


def test_other_pitch_types_count_only_towards_the_total(spark):
    table = sums(spark, *in_play(2), dict(pitch_type_condensed="EP"), dict(pitch_type_condensed=None))
    counts = {r.pitch_type_condensed: r.totalPitches for r in profiles.hitter_counts(table).collect()}
    assert counts == {"FF": 4, "EP": 4, None: 4}
    assert [r.pitch_type_condensed for r in profiles.hitter_profiles(table, NO_HITTER).collect()] == ["FF"]


def test_thresholds_are_strict(spark):
    table = sums(spark, *in_play(3))
    kept = [HitterThresholds(2, 2, 2), HitterThresholds(3, 2, 2), HitterThresholds(2, 3, 2),
            HitterThresholds(2, 2, 3)]
    assert [profiles.hitter_profiles(table, t).count() for t in kept] == [1, 0, 0, 0]


def test_a_missing_description_drops_the_group(spark):
    table = sums(spark, *in_play(3), dict(description=None))
    assert profiles.hitter_counts(table).first().BIP is None
    assert profiles.hitter_profiles(table, NO_HITTER).count() == 0


def test_missing_batters_form_a_group(spark):
    table = sums(spark, *in_play(3, batter=None))
    assert profiles.hitter_profiles(table, NO_HITTER).first().batter is None


def pitcher_sums(spark, *changes):
    return profiles.pitcher_sums(relevant_pitches(pitches(spark, *changes)))


def test_movement_counts_modelled_pitches_only(spark):
    table = pitcher_sums(
        spark,
        dict(release_speed="90"), dict(release_speed="94"), dict(release_speed=None),
        dict(release_speed="50", events="field_error", description="hit_into_play"),
        dict(pitch_type_condensed="SL", events="field_error", description="hit_into_play"),
    )
    rows = profiles.pitcher_movement(table).collect()
    assert [(r.pitch_type_condensed, r.avgVelo) for r in rows] == [("FF", 92.0)]
    assert rows[0].sdVelo == pytest.approx(statistics.stdev([90, 94]))
    usage = {r.pitch_type_condensed: (r.pitches, r.usagePCT)
             for r in profiles.pitcher_usage(table, NO_PITCHER).collect()}
    assert usage == {"FF": (4, 0.8), "SL": (1, 0.2)}
    assert profiles.pitcher_profiles(table, NO_PITCHER).count() == 1


def test_deviation_of_one_pitch_is_null(spark):
    assert profiles.pitcher_movement(pitcher_sums(spark, {})).first().sdVelo is None


def test_a_pitcher_with_two_hands_has_two_rows_and_one_usage(spark):
    table = pitcher_sums(spark, dict(p_throws="L"), dict(p_throws="R"), dict(pitch_type_condensed="SL"))
    rows = collected(profiles.pitcher_profiles(table, NO_PITCHER), "pitch_type_condensed", "p_throws")
    assert [(r["pitch_type_condensed"], r["p_throws"], r["pitches"]) for r in rows] == [
        ("FF", "L", 2), ("FF", "R", 2), ("SL", "R", 1),
    ]


HITTERS = "batter long, pitch_type_condensed string, p_throws string, stand string, " + ", ".join(
    f"{c} double" for c in ("avgEV", "avgLA", "zSwingPCT", "oSwingPCT", "sz_bot", "sz_top")
)
GENERIC = HITTERS.replace("batter long, pitch_type_condensed string, p_throws string, stand string",
                          "stand string, pitch_type_condensed string, p_throws string")


def enriched(spark, changes, hitters, generic=()):
    rows = labelled_pitches(relevant_pitches(pitches(spark, *changes)))
    return training.training_table(
        rows, spark.createDataFrame(list(hitters), HITTERS),
        spark.createDataFrame(list(generic), GENERIC),
    )


STATS = (80.0, 1.0, 0.5, 0.25, 1.0, 3.0)
ANY = (70.0, 2.0, 0.4, 0.2, 9.0, 9.0)


def test_switch_hitter_has_two_rows_per_pitch(spark):
    both = [(20, "FF", "R", side, *STATS) for side in "LR"]
    rows = enriched(spark, [{}], both).collect()
    assert sorted(r.prof_stand for r in rows) == ["L", "R"]
    assert {r.stand for r in rows} == {"R"} and {r.sz_bot for r in rows} == {1.5}


def test_fallback_is_per_row_not_per_column(spark):
    own = [(20, "FF", "R", "R", 80.0, None, 0.5, 0.25, 1.0, 3.0),
           (21, "FF", "R", "R", None, 5.0, 0.5, 0.25, 1.0, 3.0)]
    rows = enriched(
        spark, [dict(batter=20), dict(batter=21), dict(batter=22)], own,
        [("R", "FF", "R", *ANY)],
    )
    got = {r["batter"]: (r["avgEV"], r["avgLA"], r["prof_stand"]) for r in rows.collect()}
    assert got == {20: (80.0, None, "R"), 21: (70.0, 2.0, "R"), 22: (70.0, 2.0, None)}


def test_missing_keys_match_missing_keys(spark):
    rows = enriched(
        spark, [dict(batter=None), dict(batter=5, stand=None, pitch_type_condensed=None)],
        [(None, "FF", "R", "R", *STATS)], [(None, None, "R", *ANY)],
    )
    assert {r["batter"]: r["avgEV"] for r in rows.collect()} == {None: 80.0, 5: 70.0}


def test_incomplete_rows_are_dropped(spark):
    rows = enriched(
        spark,
        [dict(batter=1), dict(batter=2, release_speed="?"), dict(batter=3, plate_x=None),
         dict(batter=4, events=None, description="hit_into_play")],
        [], [("R", "FF", "R", *ANY)],
    )
    assert rows.count() == 4
    assert [r.batter for r in training.complete_rows(rows, training.REQUIRED).collect()] == [1]
    assert training.complete_rows(rows).count() == 0


def test_rows_are_bound_by_name(spark):
    left = spark.createDataFrame([(1, "a")], "x int, y string")
    right = spark.createDataFrame([(2.5, 2)], "z double, x int")
    got = collected(training.bind_rows(left, right), "x")
    assert got == [dict(x=1, y="a", z=None), dict(x=2, y=None, z=2.5)]
