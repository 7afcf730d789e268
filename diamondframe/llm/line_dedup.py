"""Line dedup: a line found in several documents stays in one of them.

Lines are exploded, normalised and hashed; the documents of each hash are reduced before
the shuffle; the positions to drop go back to their document, which is put together again
from the positions that are left. Columns and rows only, no Python on the executors.

Defined results: a missing or empty text is one empty line; rows without doc_id are one
document that sorts first; repeated rows get equal results; an empty table gives an empty
table; other columns of the input pass through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondframe.llm.common import (
    BLANKS, ascii_lower, id_key, other_columns, read_table, text_value,
)
from diamondframe.session import written


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line long enough: document, hash of its text, position, two hashes of the key."""
    text = text_value()
    lines = docs.select(
        id_key().alias("id"), F.xxhash64(text).alias("version"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    keyed = lines.select("id", "version", "pos", key.alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select(
        "id", "version", "pos",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"),
    )


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """A row (h1, h2, keep) per line key of at least ``min_docs`` documents.

    ``keep`` is the smallest document. With two documents the threshold is met when smallest
    and largest differ, which needs no distinct pass.
    """
    lines = _lines(docs, min_chars)
    if min_docs <= 1:
        raise ValueError("min_docs must be 2 or more")
    counted = lines.groupBy("h1", "h2")
    if min_docs == 2:
        found = counted.agg(F.min("id").alias("keep"), F.max("id").alias("last"))
        return found.filter("keep < last").select("h1", "h2", "keep")
    found = counted.agg(F.min("id").alias("keep"), F.count_distinct("id").alias("n"))
    return found.filter(F.col("n") >= min_docs).select("h1", "h2", "keep")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The input with ``kept_text``, ``n_lines`` and ``n_dropped``, which replace columns so named.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` documents stay in the smallest
    doc_id that holds them, with all their lines there, and go from every other.
    """
    repeated = written(repeated_lines(docs, min_chars, min_docs), "repeated-lines")
    # A hot line meets its one row of a written table, so the adaptive join can split it.
    drops = (
        _lines(docs, min_chars).join(repeated, ["h1", "h2"]).filter("id <> keep")
        .groupBy("id", "version").agg(F.collect_set("pos").alias("positions"))
    )
    text = text_value()
    joined = docs.join(
        drops, (id_key() == drops["id"]) & (F.xxhash64(text) == drops["version"]), "left"
    )
    positions = drops["positions"]
    parts = F.split(text, "\n")
    # array_except looks positions up in a hash set; a text of a million lines is no problem.
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), positions)
    kept = F.when(positions.isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    )
    return joined.select(
        *other_columns(docs, "kept_text", "n_lines", "n_dropped"),
        kept.alias("kept_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(positions.isNull(), 0).otherwise(F.size(positions)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


QUERIES = {"op4_line_dedup": op4_line_dedup}

ORACLES = {
    "op4_line_dedup": r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM exploded
), repeated AS (
  SELECT key, min(doc_id) AS keep FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keep AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
