"""From raw pitches to the rows, states and labels everything else is built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondframe.functions.labels import kept_outcome, outcome_class, recode_outs
from diamondframe.functions.missing import strict_max
from diamondframe.functions.states import bat_team, inning_keys, runner_flag, state_key
from diamondframe.operators.joins import null_safe_join
from diamondframe.session import written


def relevant_pitches(pitches: DataFrame) -> DataFrame:
    """Pitches of the nine regular innings with a legal count, with their states.

    Runner ids become 0/1 flags, ways of making an out become ``out``, and the batting
    team, the state key, the inning keys and the runs on the pitch are added.
    """
    legal = (F.col("inning") < 10) & (F.col("balls") < 4) & (F.col("strikes") < 3)
    flagged = pitches.filter(legal).withColumns(
        {base: runner_flag(F.col(base)) for base in ("on_1b", "on_2b", "on_3b")}
    )
    state = ["outs_when_up", "on_1b", "on_2b", "on_3b", "balls", "strikes"]
    return flagged.withColumns(
        {
            "bat_team": bat_team(F.col("inning_topbot"), F.col("home_team"), F.col("away_team")),
            "out_base_count_state": state_key(*[F.col(c) for c in state]),
            **inning_keys(),
            "events": recode_outs(F.col("events")),
            "runs_from_event": F.col("post_bat_score") - F.col("bat_score"),
        }
    )


def inning_maxima(pitches: DataFrame) -> DataFrame:
    """Per half-inning its highest score, reduced before the shuffle.

    The score is the one before each pitch, so runs on the last pitch of an inning do not
    count. One missing score leaves the whole half-inning without the value.
    """
    return pitches.groupBy("game_inning").agg(
        strict_max(F.col("bat_score")).alias("post_inning_runs")
    )


def with_inning_maximum(pitches: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """Join the written maxima: by broadcast while the table is small.

    Otherwise both sides are shuffled, and as the table is read from files the adaptive skew
    join can split an oversized half-inning, which it does not do for the result of an
    aggregate. Without ``highest`` the table is made and written here. A missing half-inning
    is one like any other.
    """
    if highest is None:
        highest = written(inning_maxima(pitches), "inning_max")
    return null_safe_join(pitches, highest, ["game_inning"])


def inning_runs(pitches: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """Attach the half-inning's highest score and the runs still to come in it."""
    known = with_inning_maximum(pitches.filter(F.col("game_inning").isNotNull()), highest)
    return known.withColumn("runs_post_ab", F.col("post_inning_runs") - F.col("bat_score"))


def labelled_pitches(pitches: DataFrame) -> DataFrame:
    """Relevant pitches with their outcome class, other outcomes dropped."""
    label = outcome_class(F.col("events"), F.col("description"))
    return pitches.withColumn("events", label).filter(kept_outcome(F.col("events")))
