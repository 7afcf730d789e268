"""Missing-value semantics: aggregates that refuse gaps, text keys that spell them out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def complete(value: Column, result: Column) -> Column:
    """``result`` when no row of the group lacks ``value``, else null."""
    return F.when(F.count(value) == F.count(F.lit(1)), result)


def strict_max(value: Column) -> Column:
    """Maximum that is null as soon as one value is missing."""
    return complete(value, F.max(value))


def strict_min(value: Column) -> Column:
    """Minimum that is null as soon as one value is missing."""
    return complete(value, F.min(value))


def strict_count_if(condition: Column) -> Column:
    """Number of rows meeting the condition; null as soon as it is undecided for one."""
    return complete(condition, F.count_if(condition))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when there is nothing to divide by."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def part(value: Column) -> Column:
    """A key part as text, with the text ``NA`` for a missing one."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def joined_key(*values: Column) -> Column:
    """Parts joined by underscores; no part is ever skipped."""
    return F.concat_ws("_", *[part(v) for v in values])


def number(value: Column) -> Column:
    """Text to double; unreadable text and NaN are null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))
