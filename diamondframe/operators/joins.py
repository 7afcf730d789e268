"""Joins in which a missing key matches a missing key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys``; the left side's key columns are kept.

    Written tables on the right are broadcast by the planner while their files are small.
    Larger ones are shuffled, and the adaptive skew join splits a hot key. It does so only
    when both sides come straight from a shuffle, hence a written table and not an
    aggregate on the right.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    equal = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, equal), how)
    return joined.drop(*[f"_right_{k}" for k in keys])
