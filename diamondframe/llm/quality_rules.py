"""Quality rules: base limits, and robust multivariate outliers per language and source.

Each text becomes a vector of four transformed statistics. Per language and source the
minimum covariance determinant (MCD) estimate of centre and covariance comes from
concentration steps: start from medians, keep the half of the group with the smallest
Mahalanobis distances, estimate anew, ``STEPS`` times. All of it is grouped sums
over a narrow written table, reduced before the shuffle, so a source with a third of all rows
costs no more than others; the estimates are one small file, which joins without moving rows
while the planner finds it small. Only the inverse of a 4 x 4 matrix per group is computed in
Python.

The statistics: word length, symbols per word, repeated lines per line, repeated words per
word. Each ratio is drawn towards a typical value as if by ``PRIOR_WORDS`` words more, since
short texts scatter, and all but the first are square roots. ``FLOORS`` are the least
standard deviations. For word length it lies below the usual deviation in a group (0.11 to 0.15),
so the estimate decides. The other three are zero in most texts of nearly every group: their
covariance is singular, and the floor is what about one symbol, line or phrase is worth in a
text of some hundred words; without it a single one would be an outlier.

Groups of fewer than ``LEAST_ROWS`` rows are estimated together with the other small groups
of their language, and if these are too few, with all of the rest; where even these are too
few, only the base limits judge.

Defined results: a missing or empty text has no words and fails; a missing language or
source is a value like any other; rows are judged one by one, so repeated rows and missing
doc_ids need no rule; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from diamondframe.llm.common import other_columns, read_table, release_memory, text_value
from diamondframe.llm.text_statistics import statistics
from diamondframe.session import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("x0", "x1", "x2", "x3")
FLOORS = (0.08, 0.05, 0.10, 0.10)
PRIOR_WORDS, PRIOR_CHARS = 25, 5
LEAST_ROWS, STEPS, HALF = 50, 4, 0.5
#: Share of a normal group that the distance may reject.
REJECTED_SHARE = 1e-9
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """The input with the five counts, ``group`` and ``x0`` to ``x3``; columns so named go."""
    kept = other_columns(docs, "n_lines", "group", *COUNTS, *VECTOR)
    return _counted(docs, kept).select("row.*", *COUNTS, "group", *VECTOR)


def _counted(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """``kept`` in the struct ``row``, so that its names need not be told apart."""
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    carried = docs.select(
        F.struct(*kept).alias("row"),
        F.concat_ws("\x1f", part("lang"), part("source")).alias("group"),
        text_value().alias("text"),
    )
    names = [*COUNTS, "n_lines"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).cast(pa.binary()):
                value = text.as_py()
                rows.append((*statistics(value), value.count(b"\n") + 1))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(c, pa.int64()) for c in columns]],
                ["row", "group", *names],
            )
        release_memory()

    schema = T.StructType(
        [carried.schema["row"], carried.schema["group"], *[T.StructField(n, T.LongType()) for n in names]]
    )
    counted = carried.mapInArrow(count, schema)
    words = F.col("n_words") + PRIOR_WORDS
    return counted.select(
        "row", "group", *COUNTS,
        ((F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS) / words).alias("x0"),
        F.sqrt(F.col("n_symbols") / words).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_WORDS)).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x3"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _chi2(x: float, degrees: int) -> float:
    """Share of a chi-squared variable of 4 or 6 degrees below x."""
    h = x / 2
    return 1 - math.exp(-h) * (1 + h + (h * h / 2 if degrees == 6 else 0))


def _quantile(share_above: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        h = middle / 2
        low, high = (middle, high) if math.exp(-h) * (1 + h) > share_above else (low, middle)
    return low


CUT = _quantile(REJECTED_SHARE)
#: What the covariance of the inner half is short of, for a normal group.
SCALE = HALF / _chi2(_quantile(1 - HALF), 6)


def _inverses(sums: pd.DataFrame) -> pd.DataFrame:
    """Means and inverse covariances from counts, sums and sums of products."""
    rows = []
    for r in sums.to_dict("records"):
        mean = np.array([r[f"s{i}"] for i in range(4)]) / r["n"]
        cov = np.zeros((4, 4))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = (r[f"p{i}{j}"] / r["n"] - mean[i] * mean[j]) * r["scale"]
        inverse = np.linalg.inv(cov + np.diag(np.square(FLOORS)))
        rows.append([r["pool"], *mean, *[inverse[i, j] for i, j in _PAIRS]])
    return pd.DataFrame(rows, columns=["pool", *_MEANS, *_PRECISIONS])


_MEANS = [f"m{i}" for i in range(4)]
_PRECISIONS = [f"v{i}{j}" for i, j in _PAIRS]
_PARAMETERS = "pool string, " + ", ".join(f"{c} double" for c in [*_MEANS, *_PRECISIONS])


def _distance() -> Column:
    d = [F.col(VECTOR[i]) - F.col(f"m{i}") for i in range(4)]
    return reduce(
        lambda a, b: a + b,
        [F.col(f"v{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in _PAIRS],
    )


def pools(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """(group, pool): a group large enough is its own pool; written."""
    language = F.substring_index("group", "\x1f", 1)
    sizes = written(rows.groupBy("group").agg(F.count("*").alias("n")), "group-sizes")
    rest = F.concat(F.lit("rest\x1f\x1f"), language)
    first = sizes.withColumn("pool", F.when(F.col("n") >= least, F.col("group")).otherwise(rest))
    of_pool = first.groupBy("pool").agg(F.sum("n").alias("pooled"))
    second = first.join(of_pool, "pool").select(
        "group", F.when(F.col("pooled") >= least, F.col("pool")).otherwise(F.lit("rest")).alias("pool")
    )
    return written(second.repartition(1), "pools")


def estimates(rows: DataFrame, steps: int = STEPS, least: int = LEAST_ROWS) -> DataFrame:
    """(group, centre, inverse covariance) by MCD from a written table of group and vector."""
    of_group = pools(rows, least)
    pooled = rows.join(of_group, "group")
    middle = pooled.groupBy("pool").agg(
        F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    ).filter(F.col("n") >= least).drop("n")
    # The first distances take each statistic by itself, in units of its floor.
    start = middle.select(
        "pool", *_MEANS,
        *[F.lit(1 / FLOORS[i] ** 2 if i == j else 0.0).alias(f"v{i}{j}") for i, j in _PAIRS],
    )
    # Small tables go into one file, or their many small ones would seem too large to broadcast.
    found = written(start.repartition(1), "mcd")
    for _ in range(steps):
        far = pooled.join(found, "pool").withColumn("d", _distance())
        edges = far.groupBy("pool").agg(F.percentile_approx("d", HALF, 1000).alias("edge"))
        inner = far.join(written(edges.repartition(1), "mcd-edges"), "pool").filter("d <= edge")
        sums = inner.groupBy("pool").agg(
            F.count("*").alias("n"), F.lit(SCALE).alias("scale"),
            *[F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)],
            *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in _PAIRS],
        )
        found = written(
            sums.repartition(1).mapInPandas(lambda batches: map(_inverses, batches), _PARAMETERS), "mcd"
        )
    return written(of_group.join(found, "pool").drop("pool").repartition(1), "estimates")


def judge(rows: DataFrame, found: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows of ``with_statistics`` with ``base_failed``, ``distance`` and ``kept``."""
    joined = rows.join(found, "group", "left").withColumn("distance", F.sqrt(_distance()))
    fine = F.coalesce(F.col("distance") <= math.sqrt(cut), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & fine
    ).drop(*_MEANS, *_PRECISIONS)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the input's columns. Texts are read twice, not moved."""
    vectors = written(_counted(docs, [docs["text"].isNull().alias("none")]).select("group", *VECTOR), "vectors")
    rows = _counted(docs, other_columns(docs))
    return judge(rows, estimates(vectors)).filter("kept").select("row.*")


def op8_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = written(with_statistics(docs).drop("text", "lang", "source"), "statistics")
    return judge(rows, estimates(rows)).select(
        "doc_id", *COUNTS, "base_failed", "kept", "distance"
    )


QUERIES = {"op8_quality_rules": op8_quality_rules}
