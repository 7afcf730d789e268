"""Row order across a whole table without ever sorting it in one task.

The rows are dealt into ranges of the complete order, by ``repartitionByRange``, and written
with the number of their range. Window functions work inside a range; what a range has to know
of others is carried in a small table with one row per range, or per range and partition.

It is the same at every size. Spark chooses the bounds from a sample and the number of ranges
from the size of the data, at most the shuffle partitions; the bounds decide the balance, not
the result. A hot key spreads over ranges by the order columns that follow it, and rows that
are equal in all of them by a hash of the whole row.

The rows are written with all their columns, so select those that are needed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from diamondframe.functions.missing import strict_min
from diamondframe.session import written


def _default(kind: T.DataType) -> Column:
    return F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)


def _without_nulls(df: DataFrame, named: dict[str, Column]) -> dict[str, Column]:
    """Two non-null columns per value, sorting a missing value last.

    Equality on them is plain equality, so a join can use the partitioning of a window.
    """
    if not named:
        return {}
    kinds = df.select(*[c.alias(n) for n, c in named.items()]).schema
    flat = {}
    for name, column in named.items():
        flat[f"{name}_missing"] = column.isNull()
        flat[name] = F.coalesce(column, _default(kinds[name].dataType))
    return flat


def _in_ranges(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[Column]]:
    """The rows, written with ``_range`` and ``_tie``; and the complete order."""
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    complete = [*[F.col(c).asc_nulls_last() for c in order], F.col("_tie")]
    dealt = tied.repartitionByRange(*complete).withColumn("_range", F.spark_partition_id())
    return written(dealt, "ranges"), complete


def lead_in_order(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, as ``values[name] = column``, the column's value in the table's next row.

    The order runs over the whole table, missing keys last; the last row gets null.
    """
    rows, complete = _in_ranges(df, order)
    value = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    inside = Window.partitionBy("_range").orderBy(*complete)
    key = F.struct(*[f for c in order for f in (F.col(c).isNull(), F.col(c))], "_tie")
    heads = rows.groupBy("_range").agg(F.min_by(value, key).alias("_head"))
    # One row per range, at most the number of shuffle partitions.
    beyond = F.lead("_head").over(Window.orderBy("_range"))
    heads = heads.select("_range", beyond.alias("_beyond"))
    joined = rows.withColumn("_ahead", F.lead(value).over(inside)).join(heads, "_range")
    following = F.coalesce("_ahead", "_beyond")
    return joined.withColumns({n: following[n] for n in values}).drop(
        "_range", "_tie", "_ahead", "_beyond"
    )


def number_in_order(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    name: str,
    lowest: dict[str, str] | None = None,
) -> DataFrame:
    """Add the row's position, from 1, within its partition: an exact row number.

    A partition may hold any share of the table; the parts of it in each range are numbered
    in parallel and shifted by the sizes of the parts before them. ``lowest[name] = column``
    also adds the column's minimum over the partition, null if one value is missing: it
    travels with the sizes and costs no shuffle of its own.
    """
    lowest = lowest or {}
    rows, complete = _in_ranges(df, [*partition, *order])
    outer = _without_nulls(rows, {f"_part_{p}": F.col(p) for p in partition})
    rows, part = rows.withColumns(outer), list(outer)
    sizes = rows.groupBy(*part, "_range").agg(
        F.count(F.lit(1)).alias("_size"),
        *[strict_min(F.col(c)).alias(f"_low_{n}") for n, c in lowest.items()],
    )
    # A partition has at most one row here for each range.
    whole = Window.partitionBy(*part)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = {n: F.count(f"_low_{n}").over(whole) == F.count("_size").over(whole) for n in lowest}
    offsets = sizes.select(
        *part, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *[F.when(k, F.min(f"_low_{n}").over(whole)).alias(n) for n, k in known.items()],
    )
    inside = F.row_number().over(Window.partitionBy(*part, "_range").orderBy(*complete))
    return (
        rows.withColumn("_position", inside)
        .join(written(offsets, "offsets"), [*part, "_range"])
        .withColumn(name, F.col("_position") + F.col("_offset"))
        .drop(*part, "_range", "_tie", "_position", "_offset")
    )
