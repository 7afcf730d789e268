"""A training corpus from raw documents: five stages, each over all that the one before kept.

Quality rules reject documents; repeated lines go from all but one document; of near duplicates
one document stays; documents that overlap with the benchmark go; the rest is packed into
sequences. Each result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from diamondframe.llm.common import read_table
from diamondframe.llm.decontamination import clean_documents
from diamondframe.llm.line_dedup import drop_repeated_lines
from diamondframe.llm.packing import packed_documents
from diamondframe.llm.quality_rules import kept_documents
from diamondframe.llm.shingle_join import one_text_of_each_group
from diamondframe.llm.word_pieces import tokenizer_file
from diamondframe.session import written

#: Words that a worker of the last stage remembers: by then the heap of an executor has grown.
REMEMBERED_WORDS = 1 << 18


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail a limit or are outliers of their language and source."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; ``n_chars`` follows."""
    # In a struct, columns with the names that the operator makes stay apart.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    found = drop_repeated_lines(docs.select("doc_id", "text", others))
    changed = F.col("n_dropped") > 0
    made = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n_chars = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(changed, n_chars).otherwise(F.col("row.n_chars"))
    return found.select([made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 80 % alike, whatever its doc_id."""
    return one_text_of_each_group(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with a benchmark item."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and offset."""
    return packed_documents(docs, tokenizer_file(), remembered=REMEMBERED_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL cannot express the robust estimates and the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
