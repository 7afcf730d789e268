"""Keyed lookups: last row wins, nested maps, first stored side, sampled keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from diamondframe.functions.draws import key_hash
from diamondframe.operators.joins import null_safe_join
from diamondframe.session import written

TYPE = "pitch_type_condensed"
#: Entries that a map of profiles may have.
MOST_ENTRIES = 64


def keyed_lookup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last one in ``order``, columns of numbers or times.

    The maximum of an order column is taken per key, before the shuffle as well and without a
    sort, and the rows that have it are found by a join with the written maxima; a key with
    very many rows costs no more than any other. A missing value comes before all others. Of
    rows that tie in the whole order, the one with the largest hash of all its columns is last.
    """
    rows = df.withColumn("_tie", F.xxhash64(*df.columns))
    for place, column in enumerate([*order, "_tie"]):
        last = written(rows.groupBy(*keys).agg(F.max(column).alias("_last")), "last-in-order")
        found = null_safe_join(rows, last, keys).filter(F.col(column).eqNullSafe(F.col("_last")))
        # After the first column there are about as many rows as keys.
        rows = found.drop("_last") if place else written(found.drop("_last"), "last-rows")
    return rows.drop("_tie").distinct()


def profile_map(
    df: DataFrame, keys: list[str], map_key: str, most: int = MOST_ENTRIES
) -> DataFrame:
    """Statistics as a map from ``map_key`` per remaining key.

    ``df`` must hold one row per ``keys`` and ``map_key`` (see ``keyed_lookup``), with a map key
    from a short list such as the pitch types. Both are counted first: a key that stands
    twice, is missing, or would get more than ``most`` entries is an error that names it.
    """
    stats = [c for c in df.columns if c not in keys and c != map_key]
    rows = written(df, "profile-rows")
    counted = rows.groupBy(*keys, map_key).agg(F.count(F.lit(1)).alias("_n"))
    doubled = counted.filter((F.col("_n") > 1) | F.col(map_key).isNull()).first()
    if doubled:
        named = ", ".join(f"{c}={doubled[c]}" for c in [*keys, map_key])
        raise ValueError(f"{doubled['_n']} rows with {named}: a map needs one, with a key")
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).first()
    if large:
        named = ", ".join(f"{c}={large[c]}" for c in keys)
        raise ValueError(f"{large['_n']} entries for {named}: more than {most}")
    entry = F.struct(F.col(map_key), F.struct(*stats))
    return rows.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("profiles")
    )


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def sample_keys(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` distinct values of ``key``, drawn uniformly without replacement."""
    chance = key_hash(seed, F.col(key))
    return distinct_keys(df, [key]).orderBy(chance, key).limit(k)


def pitcher_arsenals(profiles: DataFrame) -> DataFrame:
    """The profiles a pitcher is scored with: those of the hand stored first.

    Profiles are stored by pitcher and pitch type; the window sees one pitcher's few
    profiles.
    """
    stored = Window.partitionBy("pitcher").orderBy(
        F.col(TYPE).asc_nulls_last(), F.col("p_throws").asc_nulls_last()
    )
    return (
        profiles.withColumn("_hand", F.first("p_throws").over(stored))
        .filter(F.col("p_throws").eqNullSafe(F.col("_hand")))
        .drop("_hand")
    )


def first_stands(hitters: DataFrame) -> DataFrame:
    """The side a batter is taken to bat from against a hand: the one stored first."""
    return hitters.groupBy("batter", "p_throws").agg(
        F.min_by("stand", F.struct(TYPE, "stand")).alias("stand")
    )

