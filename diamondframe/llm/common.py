"""What several operators share: reading documents, row identity, ASCII folding."""

from __future__ import annotations

import ctypes
import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a missing doc_id inside an operator; all rows without one are one document,
#: which sorts before the others.
NO_ID = -(2**63)
#: Space and the five ASCII controls that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_value(key: str) -> Column:
    """The doc_id that ``id_key`` stands for."""
    return F.nullif(F.col(key), F.lit(NO_ID))


def text_value(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def other_columns(docs: DataFrame, *made: str) -> list[Column]:
    """The input's columns, without those that an operator makes under the same name."""
    names = {name.lower() for name in made}
    return [docs[f"`{c}`"] for c in docs.columns if c.lower() not in names]


def release_memory() -> None:
    """Gives back what a task's arrays have left in this process, before the worker waits idle."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
