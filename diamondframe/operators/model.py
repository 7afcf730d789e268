"""Pitch-outcome model: features, folds, fitting, grid search, scoring."""

from __future__ import annotations

from fractions import Fraction
from multiprocessing.pool import ThreadPool
from threading import Event
from typing import Any

from pyspark import keyword_only
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Normalizer, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F, types as T

from diamondframe import constants as K
from diamondframe.functions.draws import key_hash
from diamondframe.operators.ordered import number_in_order
from diamondframe.session import shared_path, written


def stratified_folds(
    df: DataFrame, label: str, key: list[str], k: int = K.FOLDS, seed: int = K.FOLD_SEED
) -> DataFrame:
    """Add ``fold``: shuffled within each label, sizes per label differing by at most one.

    One label may hold most of the rows; it is numbered in ranges of the shuffling hash.
    """
    shuffled = df.withColumn("_shuffle", key_hash(seed, *[F.col(c) for c in key]))
    numbered = number_in_order(shuffled, [label], ["_shuffle", *key], "_number")
    fold = ((F.col("_number") - 1) % k).cast("int")
    return numbered.withColumn("fold", fold).drop("_shuffle", "_number")


def label_indexer(label: str = "events") -> StringIndexer:
    """Codes in alphabetical order of the labels."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")


def feature_assembler() -> VectorAssembler:
    """The inputs in their fixed order; a missing one becomes NaN."""
    return VectorAssembler(inputCols=K.FEATURES, outputCol="features", handleInvalid="keep")


def _classes(dataset: DataFrame) -> int:
    """The number of outcomes the label was indexed with, seen in these rows or not."""
    named = dataset.schema["label"].metadata.get("ml_attr", {}).get("vals")
    return len(named) if named else int(dataset.agg(F.max("label")).first()[0]) + 1


#: Boosting rounds after which a booster's lineage is cut.
CHECKPOINT_ROUNDS = 40


class BoostedOutcomes(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for more than two outcomes.

    One binary booster per outcome on the same features; their probabilities are scaled
    to sum to one. Of two outcomes one booster says both. Each fitted stage is a Spark ML
    stage, so the result is an ordinary pipeline model. It is not the same as boosting a
    joint softmax. Every ``CHECKPOINT_ROUNDS`` rounds a booster's lineage is cut in the folder
    named by ``spark.checkpoint.dir``.
    """

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "boosting rounds", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, maxDepth=5, stepSize=0.1, maxIter=50, seed=K.FOLD_SEED):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(maxDepth=5, stepSize=0.1, maxIter=50, seed=K.FOLD_SEED)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        # The boosters cut their lineage only if the context has a folder for it.
        context = dataset.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_path(dataset.sparkSession, "boosting"))
        classes = _classes(dataset)
        present = {int(r["label"]) for r in dataset.select("label").distinct().collect()}

        def boost(code: int):
            booster = GBTClassifier(
                featuresCol="features", labelCol="_is", predictionCol=f"_pred_{code}",
                maxDepth=self.getOrDefault("maxDepth"),
                stepSize=self.getOrDefault("stepSize"),
                maxIter=self.getOrDefault("maxIter"), seed=self.getOrDefault("seed"),
                checkpointInterval=CHECKPOINT_ROUNDS,
            )
            booster.setRawPredictionCol(f"_raw_{code}").setProbabilityCol(f"_prob_{code}")
            target = (F.col("label") == code).cast("double")
            return booster.fit(dataset.select("features", target.alias("_is")))

        if classes == 2 and len(present) == 2:
            return PipelineModel([boost(1).setProbabilityCol("probability")])
        # An outcome without rows has the probability 0; the others are fitted side by side.
        with ThreadPool(min(4, max(1, len(present)))) as pool:
            fitted = dict(zip(sorted(present), pool.map(boost, sorted(present), chunksize=1)))
        stages: list[Any] = [fitted[code] for code in sorted(fitted)]
        absent = [code for code in range(classes) if code not in fitted]
        if absent:
            zeros = ", ".join(f"0D AS _none_{code}" for code in absent)
            stages.append(SQLTransformer(statement=f"SELECT *, {zeros} FROM __THIS__"))
        # A booster has two probabilities, of no and yes.
        inputs, yes, width = [], [], 0
        for code in range(classes):
            inputs.append(f"_none_{code}" if code in absent else f"_prob_{code}")
            yes.append(width if code in absent else width + 1)
            width += 1 if code in absent else 2
        stages += [
            VectorAssembler(inputCols=inputs, outputCol="_both"),
            VectorSlicer(inputCol="_both", outputCol="_yes", indices=yes),
            Normalizer(inputCol="_yes", outputCol="probability", p=1.0),
        ]
        return PipelineModel(stages)


def outcome_estimator(kind: str = "rf", seed: int = K.FOLD_SEED, **params: Any) -> Estimator:
    """An estimator with class probabilities: ``rf`` or ``ovr_gbt``."""
    if kind == "rf":
        return RandomForestClassifier(
            featuresCol="features", labelCol="label", seed=seed, **params
        )
    if kind == "ovr_gbt":
        return BoostedOutcomes(seed=seed, **params)
    raise ValueError(f"unknown kind of estimator: {kind}")


def parameter_grid(estimator: Estimator) -> list[dict]:
    """Depth x learning rate x rounds; a forest has trees but no learning rate."""
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, K.GRID_MAX_DEPTH)
    if estimator.hasParam("stepSize"):
        grid = grid.addGrid(estimator.stepSize, K.GRID_LEARNING_RATE)
        return grid.addGrid(estimator.maxIter, K.GRID_ROUNDS).build()
    return grid.addGrid(estimator.numTrees, K.GRID_ROUNDS).build()


def predicted_code(probabilities: Column) -> Column:
    """Code of the likeliest outcome, the first of equals."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def accuracy(scored: DataFrame) -> float | None:
    """Share of rows whose likeliest outcome is the recorded one."""
    counted = confusion(scored).withColumn("hit", F.col("label") == F.col("guess"))
    hits = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    row = counted.agg(hits.alias("hits"), F.sum("n").alias("rows")).first()
    return row["hits"] / row["rows"] if row["rows"] else None


def _named(params: dict) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in params.items())


def _recorded(spark, path: str, schema: str) -> list:
    """Rows of a table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _rows_by_fold(prepared: DataFrame, path: str) -> DataFrame:
    """The prepared rows below ``path``, a folder per fold; written unless an earlier run did."""
    spark = prepared.sparkSession
    if not _recorded(spark, f"{path}/rows_written", "done boolean"):
        rows = prepared.select("features", "label", F.col("fold").cast("int").alias("fold"))
        rows.write.mode("overwrite").partitionBy("fold").parquet(f"{path}/rows")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/rows_written")
    schema = prepared.select("features", "label").schema.add("fold", T.IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def confusion(scored: DataFrame) -> DataFrame:
    """How often each outcome was answered by each: ``label, guess, n``, at most classes squared."""
    guess = predicted_code(vector_to_array("probability")).cast("int")
    return scored.groupBy(F.col("label").cast("int").alias("label"), guess.alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )


_TASK = "params string, label int, guess int, n long, param_idx int, fold int"


def grid_search(
    prepared: DataFrame,
    estimator: Estimator,
    grid: list[dict],
    folds: int = K.FOLDS,
    parallelism: int = 4,
    path: str | None = None,
) -> tuple[DataFrame, dict[int, str]]:
    """Fit and test every parameter set on every fold.

    ``prepared`` has ``features, label, fold``. Its rows are written once below ``path``, by
    fold, so a fit reads the other folds' files and a test its own. Each pair is done when the
    confusion matrix of its one scoring job is written there; a search that is started again
    with the same ``path`` goes on with what is missing. Without ``path`` a fresh folder of the
    shared ones is taken. Returns one row per parameter set and fold, with counted ``hits``
    and ``rows``, and where the models fitted without fold 0 are, by parameter set.
    """
    spark = prepared.sparkSession
    path = path or shared_path(spark, "grid-search")
    rows = _rows_by_fold(prepared, path)
    models = {i: f"{path}/models/param_idx={i}" for i in range(len(grid))}
    found = _recorded(spark, f"{path}/confusion", _TASK)
    for r in found:
        if r["param_idx"] >= len(grid) or r["params"] != _named(grid[r["param_idx"]]):
            raise ValueError(f"{path} holds another search: {r['params']}")
    done = {(r["param_idx"], r["fold"]) for r in found}

    failed = Event()

    def run(task: tuple[int, int]) -> None:
        # After a failure nothing more is begun, so that the search can be started again.
        if failed.is_set():
            return
        try:
            fit_and_test(*task)
        except BaseException:
            failed.set()
            raise

    def fit_and_test(index: int, fold: int) -> None:
        model = estimator.fit(rows.filter(F.col("fold") != fold), grid[index])
        if fold == 0:
            PipelineModel([model]).write().overwrite().save(models[index])
        counted = confusion(model.transform(rows.filter(F.col("fold") == fold)))
        record = counted.select(F.lit(_named(grid[index])).alias("params"), "label", "guess", "n")
        target = f"{path}/confusion/param_idx={index}/fold={fold}"
        record.coalesce(1).write.mode("overwrite").parquet(target)

    tasks = [(i, f) for i in range(len(grid)) for f in range(folds) if (i, f) not in done]
    with ThreadPool(parallelism) as pool:
        pool.map(run, tasks, chunksize=1)
    hit = F.col("label") == F.col("guess")
    counted = spark.read.schema(_TASK).parquet(f"{path}/confusion").groupBy("param_idx", "params", "fold").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("rows")
    )
    results = counted.withColumn("accuracy", F.col("hits").cast("double") / F.col("rows").cast("double"))
    return results, models


def mean_accuracy(results: DataFrame) -> DataFrame:
    """Mean over the folds, per parameter set.

    The mean of the fractions ``hits`` / ``rows`` is exact and rounded once, so that it hangs on
    no order of a sum. There is a row per parameter set and fold, whatever the table's size.
    """
    exact: dict[tuple, list[Fraction]] = {}
    for r in results.select("param_idx", "params", "hits", "rows").collect():
        exact.setdefault((r["param_idx"], r["params"]), []).append(Fraction(r["hits"], r["rows"]))
    means = [(*names, float(sum(shares) / len(shares))) for names, shares in sorted(exact.items())]
    schema = "param_idx int, params string, average_test_accuracy double"
    return results.sparkSession.createDataFrame(means, schema)


def best_parameters(means: DataFrame) -> DataFrame:
    """The parameter set with the highest mean, the first of equals; a row per set, few."""
    return means.orderBy(F.col("average_test_accuracy").desc(), "param_idx").limit(1)


def fit_outcomes(training: DataFrame, estimator: Estimator) -> PipelineModel:
    """Fit on a training table with feature columns: codes, vector, classifier."""
    indexer, assembler = label_indexer().fit(training), feature_assembler()
    prepared = assembler.transform(indexer.transform(training)).select("features", "label")
    return PipelineModel([indexer, assembler, estimator.fit(written(prepared, "prepared"))])


def select_model(
    training: DataFrame,
    estimator: Estimator,
    grid: list[dict] | None = None,
    key: list[str] | None = None,
    folds: int = K.FOLDS,
    seed: int = K.FOLD_SEED,
    refit: bool = False,
    parallelism: int = 4,
    path: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated grid search and the model of the best parameter set.

    The model returned is the one fitted without fold 0; with ``refit`` it is fitted
    again on all rows. Also returns the mean accuracy of each parameter set, with ``best``
    marking the one whose model it is: one result serves report and choice. With ``path`` a
    search that was cut off goes on where it stopped (see ``grid_search``).
    """
    grid = grid or parameter_grid(estimator)
    indexer, assembler = label_indexer().fit(training), feature_assembler()
    folded = stratified_folds(training, "events", key or training.columns, folds, seed)
    prepared = assembler.transform(indexer.transform(folded))
    path = path or shared_path(training.sparkSession, "grid-search")
    results, models = grid_search(prepared, estimator, grid, folds, parallelism, path)
    means = mean_accuracy(results)
    index = best_parameters(means).first()["param_idx"]
    if refit:
        chosen = estimator.fit(_rows_by_fold(prepared, path), grid[index])
    else:
        chosen = PipelineModel.load(models[index]).stages[0]
    return PipelineModel([indexer, assembler, chosen]), means.withColumn("best", F.col("param_idx") == index)


def model_labels(model: PipelineModel) -> list[str]:
    """The outcomes a fitted model gives probabilities for, in order."""
    return list(model.stages[0].labels)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``probs``, the probabilities in label order."""
    rows = model.transform(df.drop("events", "label"))
    added = [c for c in rows.columns if c not in df.columns]
    return rows.withColumn("probs", vector_to_array("probability")).drop(*added)


def probability_map(labels: list[str], probs: str = "probs") -> Column:
    """Outcome to probability."""
    return F.map_from_arrays(F.array(*[F.lit(label) for label in labels]), F.col(probs))
