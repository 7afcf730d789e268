"""The best pitch for each request of a table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from diamondframe.functions.labels import side_flags
from diamondframe.functions.transitions import apply_event
from diamondframe.operators import candidates, expected, model as M
from diamondframe.operators.joins import null_safe_join
from diamondframe.plans.prepare import scoring_tables


def typed_requests(
    requests: DataFrame, tables: dict[str, DataFrame], seed: int = 0, right_only: bool = False
) -> DataFrame:
    """Requests by pitch type with every model input but the target, under the model's names."""
    tables = scoring_tables(tables)
    rows = candidates.request_types(candidates.spread(requests), tables["arsenals"])
    rows = candidates.draw_movement(rows, seed)
    rows = candidates.hitter_features(
        rows, tables["first_stands"], tables["ind_hitter_sum"], tables["generic_hitter_sum"]
    )
    return rows.withColumns(side_flags(F.col("stand"), F.col("p_throws"), right_only))


def scored_candidates(
    requests: DataFrame,
    model: PipelineModel,
    tables: dict[str, DataFrame],
    seed: int = 0,
    include_event_runs: bool = False,
    right_only: bool = False,
) -> DataFrame:
    """Every candidate of every request with its probabilities and expected runs.

    Requests are distributed once, while narrow. Everything after that happens within
    the row or against small tables.
    """
    labels = M.model_labels(model)
    values = expected.next_state_values(tables["re288"], labels, include_event_runs)
    rows = typed_requests(requests, tables, seed, right_only)
    grid = candidates.candidate_grid(expected.with_next_values(rows, values))
    return expected.expected_runs(M.score(grid, model), labels)


def recommend(
    requests: DataFrame,
    model: PipelineModel,
    tables: dict[str, DataFrame],
    seed: int = 0,
    include_event_runs: bool = False,
    right_only: bool = False,
) -> DataFrame:
    """``request_id``, pitch type, target and expected runs of the best candidate.

    Every request has a row. One without a choice has nulls and a ``reason``: its pitcher has
    no arsenal, or no candidate has a value.
    """
    tables = scoring_tables(tables)
    scored = scored_candidates(
        requests, model, tables, seed, include_event_runs, right_only
    )
    return answered(
        requests, expected.best_pitch(scored), tables, "expected_runs", "no candidate has a value"
    )


def answered(
    requests: DataFrame, found: DataFrame, tables: dict[str, DataFrame], answer: str, otherwise: str
) -> DataFrame:
    """A row per request: the one found, or nulls with a ``reason``."""
    known = tables["arsenals"].select("pitcher", F.lit(True).alias("_known")).distinct()
    asked = null_safe_join(requests.select("request_id", "pitcher"), known, ["pitcher"], "left")
    joined = null_safe_join(asked, found, ["request_id"], "left")
    why = F.when(F.col("_known").isNull(), "the pitcher has no arsenal").otherwise(otherwise)
    reason = F.when(F.col(answer).isNull(), why)
    return joined.withColumn("reason", reason).select(*found.columns, "reason")


def thrown(
    choices: DataFrame,
    model: PipelineModel,
    tables: dict[str, DataFrame],
    seed: int = 0,
    right_only: bool = False,
) -> DataFrame:
    """One pitch for each request whose pitch type and target have been chosen.

    ``choices`` are requests with ``pitch_type_condensed, plate_x, plate_z``, picked by
    ``recommend`` or by hand. The pitch misses its target, an outcome is drawn from the
    model's probabilities and the state moves on. Every request has a row; where the pitcher
    has no arsenal or does not throw the type, it has nulls and a ``reason``.
    """
    labels = M.model_labels(model)
    tables = scoring_tables(tables)
    target = ["plate_x", "plate_z"]
    wanted = choices.withColumnRenamed(candidates.TYPE, "_wanted")
    rows = candidates.request_types(candidates.spread(wanted), tables["arsenals"])
    rows = rows.filter(F.col("_wanted") == F.col(candidates.TYPE)).drop("_wanted")
    rows = candidates.draw_movement(rows, seed)
    rows = candidates.hitter_features(
        rows, tables["first_stands"], tables["ind_hitter_sum"], tables["generic_hitter_sum"]
    )
    rows = candidates.jitter_location(rows, seed).withColumns(
        side_flags(F.col("stand"), F.col("p_throws"), right_only)
    )
    drawn = candidates.draw_outcome(M.score(rows, model), labels, seed)
    after = apply_event(drawn, "drawn_event")
    found = after.select(
        "request_id", candidates.TYPE, *target, "state", "drawn_event",
        "next_state", "next_outs", "runs_scored", "at_bat_over",
    )
    return answered(choices, found, tables, "state", "the pitcher does not throw the type")
