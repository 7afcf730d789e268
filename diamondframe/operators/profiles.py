"""Hitter and pitcher profiles with sample-size thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondframe import constants as K
from diamondframe.constants import HitterThresholds, PitcherThresholds
from diamondframe.functions.labels import in_zone, kept_outcome, known_pitch_type
from diamondframe.functions.labels import outcome_class, swing
from diamondframe.functions.missing import number, ratio, strict_count_if

TYPE = "pitch_type_condensed"
HITTER_KEYS = ["batter", TYPE, "p_throws", "stand"]
GENERIC_KEYS = ["stand", TYPE, "p_throws"]
PITCHER_KEYS = ["pitcher", TYPE, "p_throws"]
_MEANS = {
    "avgEV": "launch_speed", "avgLA": "launch_angle", "sz_bot": "sz_bot", "sz_top": "sz_top",
}
_SWINGS = ["zone_swings", "zone_pitches", "chase_swings", "chase_pitches"]


def swing_zone_flags(pitches: DataFrame) -> DataFrame:
    """Batted-ball and zone metrics as numbers, with the in-zone and swing indicators."""
    metrics = ["launch_speed", "launch_angle", "sz_bot", "sz_top", "zone"]
    numeric = pitches.withColumns({m: number(F.col(m)) for m in metrics})
    return numeric.withColumns(
        {"inZone": in_zone(F.col("zone")), "swing": swing(F.col("description"))}
    )


def hitter_sums(pitches: DataFrame) -> DataFrame:
    """Counts and sums per batter, pitch type and sides: the one pass over the pitches.

    Everything about hitters follows from this table, which is why it is worth writing
    once when both profiles are needed.
    """
    inside, outside = F.col("inZone") == 1, F.col("inZone") == 0
    swung = F.col("swing") == 1
    sums: dict[str, Column] = {
        "pitches": F.count(F.lit(1)),
        "BIP": strict_count_if(F.col("description") == K.IN_PLAY_DESCRIPTION),
        "zone_swings": F.count_if(inside & swung),
        "zone_pitches": F.count_if(inside),
        "chase_swings": F.count_if(outside & swung),
        "chase_pitches": F.count_if(outside),
    }
    for stat, metric in _MEANS.items():
        sums[f"{stat}_sum"] = F.sum(metric)
        sums[f"{stat}_n"] = F.count(metric)
    return swing_zone_flags(pitches).groupBy(*HITTER_KEYS).agg(
        *[c.alias(name) for name, c in sums.items()]
    )


def _statistics(total) -> list[Column]:
    means = [ratio(total(f"{s}_sum"), total(f"{s}_n")).alias(s) for s in _MEANS]
    zone_swings, zone, chases, outside = [total(c) for c in _SWINGS]
    return [
        *means,
        ratio(zone_swings, zone).alias("zSwingPCT"),
        ratio(chases, outside).alias("oSwingPCT"),
    ]


def hitter_counts(sums: DataFrame) -> DataFrame:
    """Add the batter's total over all pitch types; the window sees reduced rows only."""
    total = F.sum("pitches").over(Window.partitionBy("batter"))
    return sums.withColumn("totalPitches", total)


def hitter_profiles(
    sums: DataFrame, thresholds: HitterThresholds = HitterThresholds()
) -> DataFrame:
    """Profiles of the batters with enough pitches and balls in play."""
    enough = (
        (F.col("totalPitches") > thresholds.total_pitches)
        & (F.col("pitches") > thresholds.pitches)
        & (F.col("BIP") > thresholds.balls_in_play)
    )
    kept = hitter_counts(sums).filter(known_pitch_type(F.col(TYPE)) & enough)
    return kept.select(*HITTER_KEYS, *_statistics(F.col)).select(*HITTER_KEYS, *K.HITTER_STATS)


def generic_hitter_profiles(sums: DataFrame) -> DataFrame:
    """Profiles over all batters, for those without one of their own."""
    grouped = sums.filter(known_pitch_type(F.col(TYPE))).groupBy(*GENERIC_KEYS)
    return grouped.agg(*_statistics(F.sum)).select(*GENERIC_KEYS, *K.HITTER_STATS)


def pitcher_sums(pitches: DataFrame) -> DataFrame:
    """Usage counts and movement statistics per pitcher, pitch type and hand, in one pass.

    Usage counts every pitch, movement only those with a modelled outcome.
    """
    kept = kept_outcome(outcome_class(F.col("events"), F.col("description")))
    flagged = pitches.withColumn("_kept", kept)
    metrics = {
        s: F.when(F.col("_kept"), number(F.col(m))).alias(s) for s, m in K.MOVEMENT.items()
    }
    measured = flagged.select(*PITCHER_KEYS, "_kept", *metrics.values())
    return measured.groupBy(*PITCHER_KEYS).agg(
        F.count(F.lit(1)).alias("thrown"),
        F.count_if(F.col("_kept")).alias("modelled"),
        *[F.avg(s).alias(f"avg{s}") for s in metrics],
        *[F.stddev_samp(s).alias(f"sd{s}") for s in metrics],
    )


def movement_columns() -> list[str]:
    return [f"avg{s}" for s in K.MOVEMENT] + [f"sd{s}" for s in K.MOVEMENT]


def pitcher_movement(sums: DataFrame) -> DataFrame:
    """Mean and sample deviation of the six movement metrics."""
    present = known_pitch_type(F.col(TYPE)) & (F.col("modelled") > 0)
    return sums.filter(present).select(*PITCHER_KEYS, *movement_columns())


def _with_usage(sums: DataFrame) -> DataFrame:
    """Pitches of the type, the pitcher's total and the share, on reduced rows."""
    by_type = F.sum("thrown").over(Window.partitionBy("pitcher", TYPE))
    total = F.sum("thrown").over(Window.partitionBy("pitcher"))
    return sums.withColumns({"pitches": by_type, "totalPitches": total}).withColumn(
        "usagePCT", ratio(F.col("pitches"), F.col("totalPitches"))
    )


def _used_enough(thresholds: PitcherThresholds) -> Column:
    return (F.col("totalPitches") > thresholds.total_pitches) & (
        F.col("usagePCT") > thresholds.usage
    )


def pitcher_usage(
    sums: DataFrame, thresholds: PitcherThresholds = PitcherThresholds()
) -> DataFrame:
    """Share of each pitch type among a pitcher's pitches."""
    by_type = sums.groupBy("pitcher", TYPE).agg(F.sum("thrown").alias("thrown"))
    columns = ["pitcher", TYPE, "pitches", "totalPitches", "usagePCT"]
    return _with_usage(by_type).filter(_used_enough(thresholds)).select(*columns)


def pitcher_profiles(
    sums: DataFrame, thresholds: PitcherThresholds = PitcherThresholds()
) -> DataFrame:
    """Usage and movement together: one row per pitcher, pitch type and hand.

    Both sides come from the same reduced table, so no join is needed.
    """
    present = known_pitch_type(F.col(TYPE)) & (F.col("modelled") > 0)
    return _with_usage(sums).filter(present & _used_enough(thresholds)).select(
        "pitcher", TYPE, "pitches", "totalPitches", "usagePCT", "p_throws",
        *movement_columns(),
    )
