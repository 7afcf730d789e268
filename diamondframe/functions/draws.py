"""Seeded randomness per row: a draw depends on the row's key, not on its partition."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

_RANGE = 2.0**32


def key_hash(seed: int, *key: Column) -> Column:
    """Hex digest of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def _word(digest: Column, index: int) -> Column:
    hex_digits = F.substring(digest, 1 + 8 * index, 8)
    return F.conv(hex_digits, 16, 10).cast("double")


def uniform(digest: Column, index: int = 0) -> Column:
    """In [0, 1), from one of the digest's four words."""
    return _word(digest, index) / F.lit(_RANGE)


def standard_normal(digest: Column) -> Column:
    """Box-Muller on the digest's first two words; the logarithm never sees zero."""
    radius = F.sqrt(F.log((_word(digest, 0) + 1) / F.lit(_RANGE + 1)) * -2)
    return radius * F.cos(uniform(digest, 1) * (2 * pi))


def around(mean: Column, sd: Column, normal: Column) -> Column:
    """A standard normal draw moved to ``mean``; without a deviation it is the mean."""
    return F.when(sd.isNull(), mean).otherwise(mean + sd * normal)


def normal(mean: Column, sd: Column, digest: Column) -> Column:
    """A draw around ``mean``; without a deviation it is the mean."""
    return around(mean, sd, standard_normal(digest))


def weighted_choice(labels: Column, weights: Column, u: Column) -> Column:
    """The label whose share of the total weight contains ``u``."""
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("upto"))

    def add(acc: Column, weight: Column) -> Column:
        total = acc["total"] + weight
        return F.struct(total.alias("total"), F.array_append(acc["upto"], total).alias("upto"))

    sums = F.aggregate(weights, start, add)
    passed = F.size(F.filter(sums["upto"], lambda s: s <= u * sums["total"]))
    return F.get(labels, F.least(passed, F.size(labels) - 1))
