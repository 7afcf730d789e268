"""Pitch tables: files, and the table derived from ``events`` for tests and checks."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from diamondframe import constants as K, schemas
from diamondframe.session import shared_path

#: Larger than any file: a file is one partition of the job that reads first lines.
WHOLE_FILE = str(1 << 40)
DERIVED_SQL = (Path(__file__).parent / "pitches_from_events.sql").read_text()
#: Changes to the derived pitches, in the order of a second table (see ``pitch_table``).
ODD_SQL = (Path(__file__).parent / "odd_pitches.sql").read_text()


def null_sentinel(df: DataFrame, token: str = K.NULL_TOKEN) -> DataFrame:
    """Text columns: the token means missing."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in text})


def read_pitches(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """A pitch table with the explicit schema; ``NA`` and ``NULL`` are missing values.

    A CSV file may hold more columns, in any order, and each file its own: columns are found
    by name, and a file without one of them is refused. Whole numbers may be written as
    ``7.0``. Text that is no such number is an error that names column and value.
    """
    if fmt != "csv":
        raw = spark.read.format(fmt).load(path)
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PITCHES]
        return null_sentinel(raw.select(*typed))
    tables = []
    for line, files in sorted(headers(spark, path).items()):
        names = next(csv.reader([line]))
        missing = set(schemas.PITCHES.names) - set(names)
        if missing:
            raise ValueError(f"{files[0]}: no column {', '.join(sorted(missing))}")
        tables.append(null_sentinel(_csv(spark, files, names)).select(*map(_typed, schemas.PITCHES)))
    if not tables:
        return spark.createDataFrame([], schemas.PITCHES)
    return reduce(DataFrame.unionByName, tables)


def headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files of each first line, found by one job however many files there are.

    Each file is one partition, of which a task reads the first line and no more. Files without
    a line have no header and no rows.
    """
    session = spark.newSession()
    for setting in ("maxPartitionBytes", "openCostInBytes"):
        session.conf.set(f"spark.sql.files.{setting}", WHOLE_FILE)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = session.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    found: dict[str, list[str]] = {}
    for r in lines.mapInArrow(first, "value string, file string").collect():
        found.setdefault(r["value"].removeprefix("\ufeff"), []).append(r["file"])
    return {line: sorted(map(_plain_path, files)) for line, files in found.items()}


def _plain_path(file: str) -> str:
    """A path to read from, of the encoded one that Spark reports: nothing in it is a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


def _csv(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """Files of one header, everything as text; a second column of a name is numbered."""
    unique = [n if names.index(n) == k else f"{n}_{k}" for k, n in enumerate(names)]
    every = T.StructType([T.StructField(n, T.StringType()) for n in unique])
    return spark.read.schema(every).csv(files, header=True, nullValue="NA")


def _typed(field: T.StructField) -> Column:
    text = F.trim(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    value = F.expr(f"try_cast(trim(`{field.name}`) as decimal(38, 6))")
    readable = value.isNotNull() & (value == F.floor(value))
    error = F.raise_error(F.concat(F.lit(f"{field.name}: not a whole number: "), text))
    return (
        F.when(text.isNull(), None).when(readable, value.cast(field.dataType)).otherwise(error)
    ).cast(field.dataType).alias(field.name)


def pitches_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch table derived by fixed arithmetic from the ``events`` table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    text = DERIVED_SQL.replace("FROM events", "FROM {events}")
    return null_sentinel(spark.sql(text, events=events))


def odd_pitches_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pitches with what a clean season lacks: switch hitters, pitchers of both hands,
    missing scores, games, batters and pitchers, and keys that stand twice."""
    text = ODD_SQL.replace("FROM pitches", "FROM {pitches}")
    return spark.sql(text, pitches=pitches_from_events(spark, sf_dir))


_PATHS: dict[tuple[str, str, bool], str] = {}
_ODD: ContextVar[bool] = ContextVar("odd pitches", default=False)


@contextmanager
def odd_pitches() -> Iterator[None]:
    """Inside, ``pitch_table`` is the table of odd pitches."""
    token = _ODD.set(True)
    try:
        yield
    finally:
        _ODD.reset(token)


def pitch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived pitches as a written table, made once per application and folder.

    It stands for the pitch file a user would have: queries scan only the columns they
    need, with their filters pushed down to the files. ``events`` may be one small file, so
    its three columns are dealt out first: the rows are made and written, and every scan after
    it runs, in parallel.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _ODD.get())
    if key not in _PATHS:
        path = shared_path(spark, "pitches")
        derived = odd_pitches_from_events if _ODD.get() else pitches_from_events
        derived(spark, sf_dir).write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])
