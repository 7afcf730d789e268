from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from diamondframe import constants as K
from diamondframe.functions import draws, geometry, labels, missing, states, transitions
from frames import pitches

EVENTS = [*K.KEPT_EVENTS, "field_error", None]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_state_key_spells_out_missing_parts(spark):
    nothing = F.lit(None).cast("long")
    key = states.state_key(nothing, F.lit(1), F.lit(0), F.lit(1), F.lit(3), F.lit(2))
    assert one(spark, key) == "NA_101_32"


def test_state_key_and_parse_are_inverse(spark):
    parsed = states.parse_state(F.lit("2_110_31"))
    row = spark.range(1).select(*[c.alias(n) for n, c in parsed.items()]).first().asDict()
    assert row == dict(outs=2, b1=1, b2=1, b3=0, balls=3, strikes=1)


def test_parse_of_a_missing_part_is_null(spark):
    assert one(spark, states.parse_state(F.lit("NA_000_00"))["outs"]) is None


def test_inning_keys_never_skip_a_part(spark):
    rows = pitches(spark, dict(inning_topbot=None, at_bat_number=7, pitch_number=3))
    keys = rows.select(*[c.alias(n) for n, c in states.inning_keys().items()]).first()
    assert keys["game_inning"] == "1_1_NA"
    assert keys["game_inning_ab_pitch"] == "1_1_NA_7_3"
    assert keys["next_at_bat_number"] == 8 and keys["next_game_inning_ab"] == "1_1_NA_8"


@pytest.mark.parametrize(
    ("half", "team"), [("Bot", "H"), ("Top", "A"), ("other", "A"), (None, None)]
)
def test_bat_team(spark, half, team):
    column = states.bat_team(F.lit(half).cast("string"), F.lit("H"), F.lit("A"))
    assert one(spark, column) == team


@pytest.mark.parametrize(
    ("event", "description", "label"),
    [
        ("strikeout", "swinging_strike", "strike"),
        ("walk", "ball", "ball"),
        ("walk", "automatic_ball", "walk"),
        ("field_out", "hit_into_play", "out"),
        (None, "foul", "foul"),
        (None, "foul_tip", "strike"),
        ("single", None, "single"),
        (None, None, None),
    ],
)
def test_outcome_class(spark, event, description, label):
    recoded = labels.recode_outs(F.lit(event).cast("string"))
    assert one(spark, labels.outcome_class(recoded, F.lit(description).cast("string"))) == label


def test_missing_outcome_is_kept_and_others_are_not(spark):
    kept = [one(spark, labels.kept_outcome(F.lit(e).cast("string"))) for e in EVENTS]
    assert kept == [True] * len(K.KEPT_EVENTS) + [False, True]


def test_zone_and_swing_indicators(spark):
    def zone(v):
        return one(spark, labels.in_zone(F.lit(v).cast("double")))

    assert (zone(9), zone(10), zone(14), zone(None)) == (1, 0, 0, None)
    assert one(spark, labels.swing(F.lit(None).cast("string"))) == 0
    assert one(spark, labels.swing(F.lit("missed_bunt"))) == 1
    assert one(spark, labels.swing(F.lit("called_strike"))) == 0


def test_number_reads_text_and_refuses_the_rest(spark):
    values = ["1.5", " 2 ", "1e2", "abc", "", "NaN", None]
    got = [one(spark, missing.number(F.lit(v).cast("string"))) for v in values]
    assert got == [1.5, 2.0, 100.0, None, None, None, None]


def test_ratio_of_nothing_is_null(spark):
    assert one(spark, missing.ratio(F.lit(0), F.lit(0))) is None


def test_left_handed_pitcher_is_encoded_unless_asked_otherwise(spark):
    def flags(**options):
        made = labels.side_flags(F.lit("L"), F.lit("L"), **options)
        return spark.range(1).select(*[c.alias(n) for n, c in made.items()]).first().asDict()

    assert flags() == dict(stand_L=1, stand_R=0, p_throws_L=1, p_throws_R=0)
    assert flags(right_only=True) == dict(stand_L=1, stand_R=0, p_throws_L=0, p_throws_R=1)


def expected_move(state, event):
    """The rules of the game, base by base, independently of the column expressions."""
    outs, runners, balls, strikes = state
    if event == "ball" and balls < 3:
        return (outs, runners, balls + 1, strikes), 0, False
    if event == "strike" and strikes < 2:
        return (outs, runners, balls, strikes + 1), 0, False
    if event == "foul":
        return (outs, runners, balls, min(2, strikes + 1)), 0, False
    if event in ("strike", "out"):
        return (outs + 1, runners, 0, 0), 0, True
    if event in ("ball", "hit_by_pitch"):
        table = {
            "000": "100", "010": "110", "001": "101", "011": "111",
            "100": "110", "110": "111", "101": "110", "111": "111",
        }
        return (outs, table[runners], 0, 0), int(runners == "111"), True
    if event in K.BASES_PER_HIT:
        n, runs, after = K.BASES_PER_HIT[event], 0, set()
        for base in [0] + [b for b in (1, 2, 3) if runners[b - 1] == "1"]:
            if base + n >= 4:
                runs += 1
            else:
                after.add(base + n)
        return (outs, "".join("1" if b in after else "0" for b in (1, 2, 3)), 0, 0), runs, True
    return state, 0, False


def test_every_transition(spark):
    situations = [
        (o, b1, b2, b3, b, s, e)
        for o in range(3) for b1 in (0, 1) for b2 in (0, 1) for b3 in (0, 1)
        for b in range(4) for s in range(3) for e in EVENTS
    ]
    schema = "outs int, b1 int, b2 int, b3 int, balls int, strikes int, events string"
    moved = transitions.apply_event(spark.createDataFrame(situations, schema)).collect()
    assert len(moved) == 288 * len(EVENTS)
    for r in moved:
        runners = f"{r.b1}{r.b2}{r.b3}"
        (outs, after, balls, strikes), runs, over = expected_move(
            (r.outs, runners, r.balls, r.strikes), r.events
        )
        assert r.next_state == f"{outs}_{after}_{balls}{strikes}", r
        assert (r.runs_scored, r.at_bat_over) == (runs, over), r
        if over:
            assert (r.next_balls, r.next_strikes) == (0, 0)
        if r.events in K.BASES_PER_HIT:
            assert runners.count("1") + 1 == after.count("1") + runs


def test_batting_order_wraps(spark):
    slot = transitions.advance_slot(F.lit(8), F.lit(True))
    assert one(spark, slot) == 0
    assert one(spark, transitions.advance_slot(F.lit(8), F.lit(False))) == 8


def test_targets_by_pitch_type(spark):
    assert one(spark, geometry.horizontal_steps()) == [-2, -1, 0, 1, 2]
    assert one(spark, geometry.vertical_steps(F.lit("CT"))) == [-2, -1, 0, 1, 2]
    assert one(spark, geometry.vertical_steps(F.lit("SL"))) == [-2, -1, 0]
    top = one(spark, geometry.plate_z(F.lit(2), F.lit(1.5), F.lit(3.5)))
    assert top == pytest.approx(2.5 + 2 * 2 / 3)
    assert one(spark, geometry.plate_x(F.lit(-2))) == pytest.approx(-4 * 9.97 / 12 / 3)


def test_draws_look_normal_and_repeat(spark):
    digest = draws.key_hash(3, F.col("id"))
    z = spark.range(20000).select(draws.standard_normal(digest).alias("z"))
    mean, sd = z.agg(F.avg("z"), F.stddev_samp("z")).first()
    assert abs(mean) < 0.03 and abs(sd - 1) < 0.03
    assert z.repartition(3).agg(F.sum("z")).first()[0] == pytest.approx(
        z.agg(F.sum("z")).first()[0]
    )
    assert one(spark, draws.normal(F.lit(4.0), F.lit(None).cast("double"), F.md5(F.lit("a")))) == 4


def test_weighted_choice_follows_the_weights(spark):
    names, weights = F.array(*map(F.lit, "abc")), F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))
    u = draws.uniform(draws.key_hash(5, F.col("id")))
    drawn = spark.range(20000).select(draws.weighted_choice(names, weights, u).alias("d"))
    shares = {r["d"]: r["count"] / 20000 for r in drawn.groupBy("d").count().collect()}
    assert set(shares) == {"a", "c"} and math.isclose(shares["a"], 0.25, abs_tol=0.02)
    assert one(spark, draws.weighted_choice(names, weights, F.lit(0.25))) == "c"
    assert one(spark, draws.weighted_choice(names, weights, F.lit(0.999999))) == "c"
