"""Toxicity: clauses scored by the weighted grammar of ``toxic_grammar``.

The insult transducer's words and stems and their weights are learned from labelled rows,
at most ``LABELLED`` of each class, the ones with the smallest hashes of their doc_id. Rows
that look like copies of each other (equal minimum hashes of word windows) count once. Four
fifths of them give the weights: the logarithm of how much more often toxic texts hold a
word than others. The rest give the two numbers of the logistic curve that turns a text's sum
of clause scores into a probability; both classes weigh there as much as they have labels.

Scoring is a pass over the documents with the lexicon, sent to each worker. An entry stands in
at least ``LEAST_TEXTS`` and a ``LEAST_PART`` of the toxic rows fitted on, so the lexicon is
bounded by what those, at most ``LABELLED``, hold: some hundred texts' worth of words. The text
alone is scored; labels, language, source and doc_id are not read.

Defined results: a missing or empty text scores as one without a word of the grammar; labels
without doc_id or value are not used, a document with both labels counts as toxic; without
labels of both classes every score is the share of toxic labels, or 0; rows are scored one by
one, so repeated rows and missing doc_ids need no rule; an empty table gives an empty table;
other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from diamondframe.llm.common import other_columns, read_table, text_value
from diamondframe.llm.text_statistics import window_hashes
from diamondframe.llm.toxic_grammar import CLAUSE_ENDS, WORD, Scorer, stems
from diamondframe.session import written

#: Labelled rows of each class that are fitted on.
LABELLED = 20_000
#: Texts that must hold a word or stem: so many, or such a part of the toxic ones; the least weight.
LEAST_TEXTS, LEAST_PART, LEAST_WEIGHT = 4, 1 / 400, 2.5
FOLDS = 5
SKETCHES = 3


def fold(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(FOLDS))


def _training(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the labelled rows to fit on, written; the labels of each class."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").select(
        F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic")
    ).filter(fold("labelled") != 0)
    one_each = written(usable.groupBy("labelled").agg(F.max("toxic").alias("toxic")), "labels")
    sizes = {r["toxic"]: r["n"] for r in one_each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("labelled")
    chosen = [one_each.filter(F.col("toxic") == k).orderBy(order, "labelled").limit(most) for k in (0, 1)]
    # At most 2 * LABELLED pairs of numbers: half a megabyte.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("labelled"), text_value().alias("text"))
    return written(rows.join(picked, "labelled"), "labelled-texts"), sizes


def _sketches(rows: DataFrame) -> DataFrame:
    """(labelled, s0, s1, s2): the smallest of three hashes over the word windows of a text."""
    seeds = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                hashes = window_hashes(text.as_py().split(), 5)
                out.append([int(((hashes * s) ^ (s >> np.uint64(7))).view(np.int64).min()) for s in seeds])
            columns = zip(*out) if out else [[]] * SKETCHES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names
            )

    names = ["labelled", *[f"s{i}" for i in range(SKETCHES)]]
    return rows.select("labelled", "text").mapInArrow(sketch, ", ".join(f"{n} long" for n in names))


def _without_copies(rows: DataFrame) -> DataFrame:
    """One row of those that share a sketch, for each sketch in turn."""
    left = written(_sketches(rows).distinct(), "sketches")
    for i in range(SKETCHES):
        rest = [f"s{k}" for k in range(i + 1, SKETCHES)]
        first = F.min(F.struct("labelled", *rest)).alias("first")
        left = left.groupBy(f"s{i}").agg(first).select("first.*")
    ids = written(left.select("labelled").distinct(), "without-copies")
    return rows.join(F.broadcast(ids), "labelled")  # no more rows than were picked


def _counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """(entry, n): texts that hold each word or stem, counted in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = set(WORD.findall(text.as_py().lower())) - CLAUSE_ENDS
                found = {s for w in words if not w.isdigit() for s in stems(w)}
                counts.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["entry", "n"],
        )

    counted = rows.select("text").mapInArrow(count, "entry string, n long")
    return counted.groupBy("entry").agg(F.sum("n").alias("n"))


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Weights of the words and stems that mark toxic texts, from (toxic, text) rows."""
    toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    frequent = _counted(toxic, None).filter(F.col("n") >= max(LEAST_TEXTS, n_toxic * LEAST_PART))
    candidates = {r["entry"]: r["n"] for r in frequent.collect()}
    others = {r["entry"]: r["n"] for r in _counted(clean, set(candidates)).collect()}
    weights = {
        entry: math.log((n + 0.5) / (n_toxic + 1)) - math.log((others.get(entry, 0) + 0.5) / (n_clean + 1))
        for entry, n in candidates.items()
    }
    return {e: w for e, w in weights.items() if w >= LEAST_WEIGHT}


def _scored(docs: DataFrame, kept: list[Column], insults: dict[str, float]) -> DataFrame:
    """``kept`` in the struct ``row``, with the sum of clause scores ``raw``."""
    carried = docs.select(F.struct(*kept).alias("row"), text_value().alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(insults)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            raw = [scorer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], ["row", "raw"])

    schema = T.StructType([carried.schema["row"], T.StructField("raw", T.DoubleType())])
    return carried.mapInArrow(score, schema)


def _curve(rows: DataFrame, insults: dict[str, float], sizes: dict[int, int]) -> tuple[float, float]:
    """Intercept and slope over log(1 + raw), by Newton steps on counts per tenth of it."""
    scored = _scored(rows, [rows["toxic"]], insults)
    tenth = F.round(F.log1p("raw") * 10).cast("int").alias("tenth")
    bins = scored.groupBy(F.col("row.toxic").alias("toxic"), tenth).agg(F.count("*").alias("n")).collect()
    have = {k: sum(r["n"] for r in bins if r["toxic"] == k) for k in (0, 1)}
    if not have[0] or not have[1]:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0
    x = np.array([r["tenth"] / 10 for r in bins])
    y = np.array([float(r["toxic"]) for r in bins])
    w = np.array([r["n"] * sizes[r["toxic"]] / have[r["toxic"]] for r in bins])
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - ridge @ beta
        hessian = (design * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[dict[str, float], float, float]:
    """Lexicon, intercept and slope from the labels outside the held-out fold."""
    rows, sizes = _training(docs, labels, most)
    unique = written(_without_copies(rows), "unique-texts")
    insults = learn_insults(unique.filter(fold("labelled") != FOLDS - 1))
    return insults, *_curve(unique.filter(fold("labelled") == FOLDS - 1), insults, sizes)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The input with ``raw``, ``score`` and ``predicted``, which replace columns so named."""
    insults, intercept, slope = fit(docs, labels, most)
    scored = _scored(docs, other_columns(docs, "raw", "score", "predicted"), insults)
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.log1p("raw"))))
    return scored.select("row.*", "raw", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op3_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
