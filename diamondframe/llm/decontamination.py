"""Benchmark decontamination by spaced seeds.

Words of letters, digits and non-ASCII characters, in lower case, of documents and benchmark
items become hashes. A mask picks some of eight consecutive words; the masks of a group leave out
different places. Every 13 words with at most two substituted ones hold all the words of one
mask of ``MASKS`` somewhere (all 78 pairs of places have been tried), so nothing is missed.
Hashes of documents and items are joined, and around each hit the aligned windows of 13 words
are compared word by word.

Shorter items are searched as a whole. Of 8 to 12 words one may be substituted: each mask of
``SHORT_MASKS`` leaves out other places of the first eight words, so one of them is untouched.
Items of 1 to 7 words are found as they stand, by one hash of all their words. The masks for a
length are looked up only if the benchmark has items of it.

A bitmap of the items' hashes, at most ``2 ** MOST_BITS`` bits (16 megabytes), goes along with
the scan and keeps nearly all words of the documents out of the join. It changes no result.
Columns and rows only, no Python on the executors; the driver sees the bitmap and the lengths
of items alone.

Defined results: an item without words is found nowhere, one of a single word in every text that
has the word; missing or empty texts have no words; rows without doc_id are one
document, in results with a missing doc_id; rows repeated with the same doc_id and text give
one result; items with equal item_id and text are one; empty tables give empty results; only
doc_id, text and item_id are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from diamondframe.llm.common import id_key, id_value, read_table, text_value
from diamondframe.session import written

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SHORT_MASKS = ((3, 4, 5, 6, 7), (0, 1, 2, 6, 7), (0, 1, 2, 3, 4, 5))
SPAN, WINDOW, SUBSTITUTED = 8, 13, 2
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 512, 16, 27
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _word_hashes() -> Column:
    words = F.array_remove(F.split(F.lower(text_value()), SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def substituted(n: int) -> int:
    """How many words of an item's n, or of a window of 13, may be others."""
    return SUBSTITUTED if n >= WINDOW else 1 if n >= SPAN else 0


def _masks(length: int) -> tuple[tuple[int, ...], ...]:
    """The masks that find items of a length."""
    if length >= WINDOW:
        return MASKS
    return SHORT_MASKS if length >= SPAN else (tuple(range(length)),)


def _seed(mask: tuple[int, ...], words: Column, at: Column) -> Column:
    """A hash of the words that a mask picks from a place on, null where they do not fit."""
    picked = F.xxhash64(F.lit(str(mask)), *[F.get(words, at + k) for k in mask])
    return F.when(at + mask[-1] < F.size(words), picked)


def _items(benchmark: DataFrame) -> DataFrame:
    hashed = benchmark.select("item_id", _word_hashes().alias("item_words")).distinct()
    return hashed.filter(F.size("item_words") > 0)


def _item_seeds(items: DataFrame) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Written seeds of all items, and the masks in use."""
    size = F.size("item_words")
    # Masks depend on the length: one of 13 stands for the longer ones.
    lengths = [r[0] for r in items.select(F.least(size, F.lit(WINDOW))).distinct().collect()]
    masks = sorted({mask for n in lengths for mask in _masks(n)})
    places = items.select("item_id", "item_words", F.posexplode("item_words").alias("item_at", "w"))
    # A whole item is known by its beginning, a longer one by every place.
    inside = places.filter((F.col("item_at") == 0) | (size >= WINDOW))

    def own(mask: tuple[int, ...]) -> Column:
        fits = reduce(lambda x, y: x | y, [
            size >= n if n == WINDOW else size == n for n in range(1, WINDOW + 1) if mask in _masks(n)
        ])
        return F.when(fits, _seed(mask, F.col("item_words"), F.col("item_at")))

    seeds = F.array_compact(F.array(*[own(m) for m in masks])) if masks else F.array().cast("array<long>")
    rows = inside.select("item_id", "item_words", "item_at", F.explode(seeds).alias("seed"))
    return written(rows, "item-seeds"), masks


def _bitmap(seeds: DataFrame) -> tuple[DataFrame, int]:
    """One row with an array of 64-bit words, and the number of bits as a power of two."""
    spark = seeds.sparkSession
    power = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_SEED * max(1, seeds.count()) - 1).bit_length()))
    bit = F.col("seed").bitwiseAND((1 << power) - 1)
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(seed & 63 as int))")
    filled = seeds.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits")).collect()
    words = [0] * (1 << power - 6)
    for r in filled:
        words[r["word"]] = r["bits"]
    return written(spark.createDataFrame([(words,)], "bits array<bigint>"), "bitmap"), power


def _hits(docs: DataFrame, seeds: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """Places of documents whose seed an item has too, with the words around them."""
    bitmap, power = _bitmap(seeds)
    bits = bitmap.scalar()
    docs = docs.select(id_key().alias("id"), F.xxhash64(text_value()).alias("version"), _word_hashes().alias("words"))
    places = docs.select("id", "version", "words", F.posexplode("words").alias("at", "w"))
    least = min((mask[-1] for mask in masks), default=0)
    inside = places.filter(F.col("at") < F.size("words") - least).select(
        "id", "version", "words", "at",
        *[_seed(mask, F.col("words"), F.col("at")).alias(f"s{n}") for n, mask in enumerate(masks)],
    )

    def known(seed: str) -> Column:
        bit = F.col(seed).bitwiseAND((1 << power) - 1)
        word = F.get(bits, F.shiftright(bit, 6).cast("int"))
        return F.coalesce(F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1, F.lit(False))

    names = [f"s{n}" for n in range(len(masks))]
    some = inside.filter(reduce(lambda x, y: x | y, map(known, names), F.lit(False)))
    before = WINDOW - SPAN
    start = F.greatest(F.col("at") - before, F.lit(0))
    return some.select(
        "id", "version", "at", F.size("words").alias("n_words"), start.alias("start"),
        F.slice("words", start + 1, F.lit(2 * before + SPAN)).alias("around"),
        F.explode(F.array(*[F.when(known(s), F.col(s)) for s in names]).cast("array<long>")).alias("seed"),
    ).filter("seed is not null")


def _best_window() -> Column:
    """(equal words, first word) of the best window of the item and document at a hit, or null."""
    size = F.least(F.lit(WINDOW), F.size("item_words"))
    least = size - F.when(size == WINDOW, SUBSTITUTED).when(size >= SPAN, 1).otherwise(0)

    def window(shift: Column) -> Column:
        item, doc = F.col("item_at") + shift, F.col("at") + shift
        equal = F.size(F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda k: F.get("item_words", item + k) == F.get("around", doc + k - F.col("start")),
        ))
        inside = (item >= 0) & (doc >= 0) & (item + size <= F.size("item_words")) & (doc + size <= F.col("n_words"))
        return F.when(inside & (equal >= least), F.struct(equal.alias("n_equal"), (-doc).alias("back")))

    return F.array_max(F.transform(F.sequence(F.least(SPAN - size, F.lit(0)), F.lit(0)), window))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, version, doc_id, item_id, n_equal, first_word) per document and item that overlap.

    ``n_equal`` are the most equal words of a window, ``first_word`` is where the first window
    with so many starts in the document.
    """
    seeds, masks = _item_seeds(written(_items(benchmark), "items"))
    joined = _hits(docs, seeds, masks).join(seeds, "seed")
    found = joined.withColumn("best", _best_window()).filter("best is not null")
    per_pair = found.groupBy("id", "version", "item_id").agg(F.max("best").alias("best"))
    return per_pair.select(
        "id", "version", id_value("id").alias("doc_id"), "item_id",
        F.col("best.n_equal").cast("long").alias("n_equal"),
        (-F.col("best.back")).cast("long").alias("first_word"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with the input's columns."""
    found = written(contamination(docs, benchmark).select("id", "version").distinct(), "contaminated")
    of_doc = (id_key() == found["id"]) & (F.xxhash64(text_value()) == found["version"])
    return docs.join(found, of_doc, "left_anti")


def op6_benchmark_decontamination(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("id", "version")


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
