"""The training table: labelled pitches enriched with hitter profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from diamondframe.functions.labels import side_flags
from diamondframe.functions.missing import number
from diamondframe.functions.states import parse_state
from diamondframe.operators.joins import null_safe_join

TYPE = "pitch_type_condensed"
PITCH_COLUMNS = [
    "out_base_count_state", "pitcher", "p_throws", TYPE,
    "release_speed", "release_pos_x", "release_pos_z", "release_pos_y", "pfx_x", "pfx_z",
    "plate_x", "plate_z", "batter", "stand", "sz_bot", "sz_top", "events",
]
NUMERIC_TEXT = [*PITCH_COLUMNS[4:12], "sz_bot", "sz_top"]
FALLBACK_STATS = ["avgEV", "avgLA", "zSwingPCT", "oSwingPCT"]


def bind_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both tables by column name; a column only one has is null in the other."""
    return first.unionByName(second, allowMissingColumns=True)


def training_table(
    labelled: DataFrame, hitters: DataFrame, generic: DataFrame, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Labelled pitches with the batter's profile, or the generic one.

    The profile is found without the batter's side, so a switch hitter with two profiles
    against a hand yields two rows per pitch; its own side and zone come along as
    ``prof_stand``, ``prof_sz_bot`` and ``prof_sz_top``. Whether the generic profile is
    used is decided per row, by a missing exit velocity, never per column.

    ``hitters`` and ``generic`` should be written tables: the planner broadcasts them
    when their files are small and joins with a shuffle otherwise.
    """
    numeric = {c: number(F.col(c)) for c in NUMERIC_TEXT}
    rows = labelled.select(*PITCH_COLUMNS, *extra).withColumns(numeric)

    own = hitters.select(
        "batter", "p_throws", TYPE,
        *[F.col(c).alias(f"prof_{c}") for c in ("stand", "sz_bot", "sz_top")],
        *[F.col(c).alias(f"own_{c}") for c in FALLBACK_STATS],
    )
    rows = null_safe_join(rows, own, ["batter", "p_throws", TYPE], "left")

    common = generic.select(
        "stand", TYPE, "p_throws", *[F.col(c).alias(f"any_{c}") for c in FALLBACK_STATS]
    )
    rows = null_safe_join(rows, common, ["stand", TYPE, "p_throws"], "left")

    has_own = F.col("own_avgEV").isNotNull()
    stats = [
        F.when(has_own, F.col(f"own_{c}")).otherwise(F.col(f"any_{c}")).alias(c)
        for c in FALLBACK_STATS
    ]
    profile = ["prof_stand", "prof_sz_bot", "prof_sz_top"]
    return rows.select(*PITCH_COLUMNS, *extra, *profile, *stats)


def complete_rows(
    df: DataFrame, columns: list[str] | None = None, report: Observation | None = None
) -> DataFrame:
    """Rows without a missing value, in all columns or in those named.

    A ``report`` counts in the same pass what is left out and why: ``rows``, ``kept`` and, per
    column, ``missing_<column>``, the rows that lack it. It is filled by the first action.
    """
    if report is None:
        return df.dropna("any", subset=columns)
    names, kinds = columns or df.columns, dict(df.dtypes)
    lacks = [
        F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
        for c in names
    ]
    # One list per row, which every count reads: the conditions themselves are not multiplied.
    listed = F.array_compact(F.array(*[F.when(lack, F.lit(c)) for c, lack in zip(names, lacks)]))
    complete = F.size("_lacks") == 0
    counted = df.withColumn("_lacks", listed).observe(
        report, F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("kept"),
        *[F.count_if(F.array_contains("_lacks", c)).alias(f"missing_{c}") for c in names],
    )
    return counted.filter(complete).drop("_lacks")


# Columns a training row must have. The profile's own side and zone are not among them,
# or every row that fell back to the generic profile would be lost.
REQUIRED = PITCH_COLUMNS + FALLBACK_STATS


def feature_columns(training: DataFrame, right_only: bool = False) -> DataFrame:
    """Add the model inputs: outs, balls and strikes out of the state, sides as 0/1."""
    parsed = parse_state(F.col("out_base_count_state"))
    state = {k: parsed[k] for k in ("outs", "balls", "strikes")}
    return training.withColumns(
        {**state, **side_flags(F.col("stand"), F.col("p_throws"), right_only)}
    )

