"""Run expectancy, run values and the expected-runs curve of an inning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from diamondframe import constants as K
from diamondframe.functions.missing import complete, strict_max, strict_min
from diamondframe.functions.transitions import advance_slot
from diamondframe.operators.ordered import lead_in_order, number_in_order
from diamondframe.operators.pitches import with_inning_maximum

PITCH_ORDER = ["game_pk", "at_bat_number", "pitch_number"]


def run_expectancy(pitches: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """Mean runs to the end of the half-inning, and pitches seen, per state.

    ``highest`` are the written maxima of ``inning_maxima``, a small part of the pitches. While
    they can be broadcast, pitches are not shuffled; otherwise once, by half-inning, in a join
    that can split a hot one. From there they are reduced to one row per state.
    """
    joined = with_inning_maximum(pitches, highest)
    to_come = joined.select(
        "out_base_count_state", (F.col("post_inning_runs") - F.col("bat_score")).alias("to_come")
    )
    mean = F.sum("to_come").cast("double") / F.count(F.lit(1)).cast("double")
    return to_come.groupBy("out_base_count_state").agg(
        complete(F.col("to_come"), mean).alias("runs_expected"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def attach_expectancy(pitches: DataFrame, expectancy: DataFrame) -> DataFrame:
    """Inner join on the state: the table has one row per state."""
    return pitches.join(
        expectancy.select("out_base_count_state", "runs_expected"), "out_base_count_state"
    )


def run_values(pitches: DataFrame, expectancy: DataFrame) -> DataFrame:
    """Change in expected runs from each pitch to the next, plus the runs it scored.

    The next pitch is the next one of the whole table in game order, so it may belong to
    another inning or game. A next state of a fresh inning counts as no runs to come.
    The table's last pitch has no value. Pitches with equal keys follow each other by
    state and score.
    """
    order = PITCH_ORDER + [
        "out_base_count_state", "bat_score", "post_bat_score", "batter", "pitcher",
    ]
    led = lead_in_order(
        attach_expectancy(pitches, expectancy),
        order,
        {
            "next_out_base_count_state": "out_base_count_state",
            "_next_expected": "runs_expected",
        },
    )
    fresh = F.col("next_out_base_count_state") == K.INNING_START
    return led.withColumn(
        "next_runs_expected",
        F.when(fresh, 0.0).when(~fresh, F.col("_next_expected")),
    ).withColumn(
        "delta_re",
        F.col("next_runs_expected") - F.col("runs_expected") + F.col("runs_from_event"),
    ).drop("_next_expected")


def inning_trajectory(pitches: DataFrame, expectancy: DataFrame) -> DataFrame:
    """Expected runs of each half-inning, pitch by pitch.

    A point is the expectancy of the state plus the runs scored so far in the inning;
    a closing point in the state of three outs holds the runs scored in total.
    """
    score = F.col("bat_score")
    innings = pitches.groupBy("game_inning").agg(
        strict_min(score).alias("start_score"),
        strict_max(F.col("post_bat_score")).alias("end_score"),
        F.count(F.lit(1)).alias("pitches"),
    )
    numbered = number_in_order(
        pitches,
        ["game_inning"],
        ["at_bat_number", "pitch_number", "out_base_count_state", "bat_score"],
        "pitch_index",
        lowest={"start_score": "bat_score"},
    )
    thrown = attach_expectancy(numbered, expectancy).select(
        "game_inning",
        F.col("pitch_index").cast("long").alias("pitch_index"),
        F.col("out_base_count_state").alias("state"),
        (F.col("runs_expected") + score - F.col("start_score")).alias("expected_total"),
    )
    closing = innings.select(
        "game_inning",
        (F.col("pitches") + 1).alias("pitch_index"),
        F.lit(K.INNING_OVER).alias("state"),
        (F.col("end_score") - F.col("start_score")).cast("double").alias("expected_total"),
    )
    return thrown.unionByName(closing)


def batting_slots(pitches: DataFrame, size: int = K.LINEUP_SIZE) -> DataFrame:
    """Batting-order slot of every at-bat of a side, from 0, and the slot that follows."""
    at_bats = pitches.select("game_pk", "inning_topbot", "at_bat_number").distinct()
    numbered = number_in_order(
        at_bats,
        ["game_pk", "inning_topbot"],
        ["at_bat_number"],
        "ordinal",
    )
    slot = ((F.col("ordinal") - 1) % size).cast("long")
    return numbered.select(
        "game_pk", "inning_topbot", "at_bat_number", slot.alias("slot"),
        advance_slot(slot, F.lit(True), size).cast("long").alias("next_slot"),
    )
