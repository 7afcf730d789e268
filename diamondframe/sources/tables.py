"""The tables handed from one job to the next."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from diamondframe import schemas
from diamondframe.operators.training import REQUIRED, complete_rows

_MANIFEST = "version string, format string, names array<string>"


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> str:
    """Write the tables as one set, which replaces the set that was there; returns its version.

    The tables go to a folder of their own below ``folder``. The last step adds the version to
    the manifest, so readers see the old set until every table of the new one is there, and a
    job that dies on the way leaves the old set in force. Old versions are not deleted.
    """
    version = f"v{time.time_ns():020d}"
    for name, table in tables.items():
        writer = table.write.format(fmt)
        if fmt == "csv":
            writer = writer.options(header=True, nullValue="NA")
        writer.save(f"{folder}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    entry = spark.createDataFrame([(version, fmt, sorted(tables))], _MANIFEST)
    entry.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return version


def current_set(spark: SparkSession, folder: str) -> dict | None:
    """``version, format, names`` of the set in force; None for a folder without a manifest."""
    try:
        entries = spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
        newest = entries.orderBy(F.col("version").desc()).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return newest[0].asDict() if newest else None


def _place(found: dict | None, folder: str, name: str, fmt: str, suffix: str) -> str:
    if found is None:
        return f"{folder}/{name}{suffix}"
    if name not in found["names"] or fmt != found["format"]:
        held = f"{', '.join(found['names'])} as {found['format']}"
        raise ValueError(f"{folder} {found['version']} holds {held}, not {name} as {fmt}")
    return f"{folder}/{found['version']}/{name}"


def read_tables(
    spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Several handoff tables, all of the same set."""
    found = current_set(spark, folder)
    return {n: _read(spark, _place(found, folder, n, fmt, ""), n, fmt, None) for n in names}


def read_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", suffix: str = "",
    report: Observation | None = None,
) -> DataFrame:
    """Read a handoff table, of the set in force, with its schema.

    CSV files may come from elsewhere, in a folder without a manifest: columns are found by
    name, an unnamed first column of row numbers is ignored, and ``NA`` is a missing value.
    Text that is no number where one is due is an error that names column and value. With a
    ``report`` it is missing instead, and after the first action on the table the report holds
    ``rows`` and, per column of numbers, ``unreadable_<column>``.
    """
    path = _place(current_set(spark, folder), folder, name, fmt, suffix)
    return _read(spark, path, name, fmt, report)


def _read(
    spark: SparkSession, path: str, name: str, fmt: str, report: Observation | None
) -> DataFrame:
    schema = schemas.TABLES[name]
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    raw = spark.read.csv(path, header=True, nullValue="NA")
    numbers = {f.name: _number(f) for f in schema if not isinstance(f.dataType, T.StringType)}
    unreadable = {c: F.col(c).isNotNull() & value.isNull() for c, value in numbers.items()}
    if report is not None:
        listed = F.array_compact(F.array(*[F.when(bad, F.lit(c)) for c, bad in unreadable.items()]))
        counts = [F.count_if(F.array_contains("_bad", c)).alias(f"unreadable_{c}") for c in unreadable]
        seen = raw.withColumn("_bad", listed).observe(report, F.count(F.lit(1)).alias("rows"), *counts)
        return seen.select(*[numbers.get(c, F.col(c)).alias(c) for c in schema.names])
    typed = {
        c: F.when(bad, F.raise_error(F.concat(F.lit(f"{name}.{c}: not a number: "), c)))
        .otherwise(numbers[c]).cast(schema[c].dataType)
        for c, bad in unreadable.items()
    }
    return raw.select(*[typed.get(c, F.col(c)).alias(c) for c in schema.names])


def _number(field: T.StructField) -> Column:
    """The value of a text, null if it is none; whole numbers may be written as ``7.0``."""
    if isinstance(field.dataType, T.LongType):
        value = F.col(field.name).try_cast("decimal(38, 6)")
        return F.when(value == F.floor(value), value.cast("long"))
    return F.col(field.name).try_cast(field.dataType)


def read_training(
    spark: SparkSession, folder: str, fmt: str = "parquet",
    columns: list[str] | None = None, report: Observation | None = None,
) -> DataFrame:
    """The training table without the rows that lack a required value.

    With a ``report``, an action on the table leaves there how many rows there were, how many
    are kept, and how many lack each column (see ``complete_rows``).
    """
    table = read_table(spark, folder, "model_data", fmt)
    return complete_rows(table, REQUIRED if columns is None else columns, report)
