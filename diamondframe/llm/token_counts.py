"""Token counts by a two-tier lookup on the map side.

First tier: the frequent words of the corpus with their numbers of tokens, a table of at
most ``FREQUENT`` short words that is broadcast. Second tier: each worker encodes the words
it misses and remembers them. No word of a text is shuffled. The table is made in a pass of
its own: a task counts its words within bounds and hands on its most frequent ones, at most
``PER_TASK`` of them. The table decides the speed only, never a count.

Defined results: a missing or empty text has no bytes and no tokens; rows are counted one
by one, so missing doc_ids and repeated rows need no rule; an empty table gives an empty
table; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from diamondframe.llm.common import other_columns, read_table, release_memory, text_value
from diamondframe.llm.word_pieces import (
    CACHE_LETTERS, load, parts, tokenizer_file, worker_cache,
)

#: Words in the broadcast table (at most 40 letters each: under 8 MB), words that a task hands
#: on, and words that a task counts at once.
FREQUENT, PER_TASK, COUNTED = 32_768, 8_192, 250_000


def _frequent_words(docs: DataFrame) -> list[str]:
    def most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for words in parts(text.as_py()):
                    counts.update(words)
                    if len(counts) > COUNTED:
                        counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(w, n) for w, n in counts.most_common(PER_TASK) if len(w) <= CACHE_LETTERS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            ["word", "n"],
        )

    counted = docs.select(text_value().alias("text")).mapInArrow(most_frequent, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
    return [r["word"] for r in top.limit(FREQUENT).collect()]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """The input with ``n_bytes``, ``n_tokens`` and ``over_limit``, which replace columns so named.

    ``tokenizer`` is the path of a file of the tokenizers library, at the same place on every
    machine. Counts are those of ``encode(text, add_special_tokens=False)``.
    """
    frequent = _frequent_words(docs)
    encoded = load(tokenizer).encode_batch(frequent, add_special_tokens=False)
    table = docs.sparkSession.sparkContext.broadcast(
        {w: len(e.ids) for w, e in zip(frequent, encoded)}
    )

    kept = other_columns(docs, "n_bytes", "n_tokens", "over_limit")
    # A struct carries what passes through, so that its names need not be told apart.
    carried = docs.select(F.struct(*kept, F.octet_length(text_value()).cast("long").alias("n_bytes")).alias("row"),
                          text_value().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer, "length", table.value)
        for batch in batches:
            n = [0] * batch.num_rows
            for row, lengths in cache.values(t.as_py() for t in batch.column(1)):
                n[row] += sum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64())], ["row", "n_tokens"]
            )
        release_memory()

    schema = T.StructType([carried.schema["row"], T.StructField("n_tokens", T.LongType())])
    counted = carried.mapInArrow(count, schema)
    return counted.select("row.*", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_file()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op5_token_counts": op5_token_counts}
