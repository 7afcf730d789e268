from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from diamondframe import constants as K
from diamondframe.operators import model as M
from diamondframe.plans import queries
from diamondframe.session import shared_path, written
from diamondframe.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def features(spark):
    """The outcome follows the pitch height, apart from every seventh row."""
    n = F.col("id")
    height = (n * 37 % 100) / 25
    planted = F.when(height < 1.3, "ball").when(height < 2.6, "strike").otherwise("single")
    rows = spark.range(900).select(
        n.alias("event_id"),
        F.when(n % 7 == 0, F.lit("out")).otherwise(planted).alias("events"),
        *[height.alias(c) if c == "plate_z" else F.lit(1.0).alias(c) for c in K.FEATURES],
    )
    return rows.persist()


def test_grid_has_27_sets():
    boosted = M.outcome_estimator("ovr_gbt")
    grid = M.parameter_grid(boosted)
    assert len(grid) == 27
    assert {p[boosted.maxDepth] for p in grid} == {3, 5, 7}
    with pytest.raises(ValueError):
        M.outcome_estimator("other")


@pytest.mark.parametrize("shares", [(5, 3, 1), (50, 1, 1)])
def test_folds_are_balanced_within_labels(spark, shares):
    labels = [name for name, share in zip("abc", shares) for _ in range(share * 11)]
    rows = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    folded = M.stratified_folds(rows.repartition(5), "label", ["id"])
    sizes = {}
    for r in folded.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], {})[r["fold"]] = r["count"]
    for label, by_fold in sizes.items():
        assert max(by_fold.values()) - min(by_fold.values()) <= 1
        assert sum(by_fold.values()) == labels.count(label)
    again = M.stratified_folds(rows, "label", ["id"])
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, again.collect()))
    other = M.stratified_folds(rows, "label", ["id"], seed=1)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, again.collect()))


def majority(features):
    counts = [r["count"] for r in features.groupBy("events").count().collect()]
    return max(counts) / sum(counts)


def hit_rate(features, model):
    scored = M.score(features, model).select("event_id", "probs")
    labels = F.array(*[F.lit(label) for label in M.model_labels(model)])
    code = M.predicted_code(F.col("probs"))
    named = scored.withColumn("guess", F.get(labels, code.cast("int")))
    return named.join(features, "event_id").agg(
        F.avg((F.col("guess") == F.col("events")).cast("double"))
    ).first()[0]


@pytest.mark.parametrize(
    ("kind", "params"), [("rf", dict(numTrees=10)), ("ovr_gbt", dict(maxIter=4, maxDepth=3))]
)
def test_model_finds_the_signal_and_survives_saving(spark, features, kind, params):
    model = M.fit_outcomes(features, M.outcome_estimator(kind, **params))
    assert M.model_labels(model) == ["ball", "out", "single", "strike"]
    sums = M.score(features, model).agg(
        F.min(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)),
        F.max(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)),
    ).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    assert hit_rate(features, model) > majority(features) + 0.2

    path = shared_path(spark, "model_test")
    save_model(model, path)
    again = load_model(path)
    assert M.model_labels(again) == M.model_labels(model)
    both = [
        sorted((r.event_id, r.probs) for r in M.score(features, m).select("event_id", "probs").collect())
        for m in (model, again)
    ]
    assert both[0] == both[1]


def test_scoring_needs_no_outcome_and_accepts_missing_inputs(spark, features):
    model = M.fit_outcomes(features, M.outcome_estimator("rf", numTrees=3))
    blank = features.drop("events").withColumn("avgEV", F.lit(None).cast("double"))
    scored = M.score(blank, model)
    assert scored.columns == [*blank.columns, "probs"]
    assert scored.filter("size(probs) = 4").count() == 900
    row = scored.select(M.probability_map(M.model_labels(model)).alias("p")).first()
    assert set(row.p) == {"ball", "out", "single", "strike"}


def test_an_outcome_without_rows_keeps_its_place(spark, features):
    """The only rows of the last outcome are not among those that are fitted on."""
    indexer = M.label_indexer().fit(features)
    rows = M.feature_assembler().transform(indexer.transform(features))
    for missing in ("strike", "out"):
        booster = M.outcome_estimator("ovr_gbt", maxIter=2, maxDepth=2)
        model = booster.fit(rows.filter(F.col("events") != missing).select("features", "label"))
        probs = model.transform(rows).select(vector_to_array("probability").alias("p")).collect()
        place = indexer.labels.index(missing)
        assert all(len(r.p) == 4 and r.p[place] == 0 and sum(r.p) == pytest.approx(1) for r in probs)


def test_search_returns_the_model_fitted_without_fold_0(spark, features):
    # One tree on all rows and features: the same model however the rows are partitioned.
    forest = M.outcome_estimator(
        "rf", numTrees=1, bootstrap=False, featureSubsetStrategy="all"
    )
    grid = [{forest.maxDepth: 1}, {forest.maxDepth: 4}]
    model, means = M.select_model(features, forest, grid, key=["event_id"], folds=3)
    found = {r.params: r for r in means.collect()}
    assert set(found) == {"maxDepth=1", "maxDepth=4"}
    assert found["maxDepth=4"].best and not found["maxDepth=1"].best

    folded = M.stratified_folds(features, "events", ["event_id"], 3)
    indexed = M.label_indexer().fit(features).transform(folded)
    prepared = M.feature_assembler().transform(indexed)
    fitted = forest.fit(prepared.filter("fold <> 0"), grid[1])
    want = fitted.transform(prepared).select("event_id", vector_to_array("probability").alias("p"))
    got = M.score(features, model).select("event_id", "probs")
    joined = want.join(got, "event_id").filter(F.col("p") == F.col("probs"))
    assert joined.count() == 900


def prepared_rows(features, folds=3):
    folded = M.stratified_folds(features, "events", ["event_id"], folds)
    indexed = M.label_indexer().fit(features).transform(folded)
    return M.feature_assembler().transform(indexed).select("features", "label", "fold")


class Counting:
    """An estimator that notes its fits, and breaks off where it is told to."""

    def __init__(self, inner, stop_at=None):
        self.inner, self.stop_at, self.fits = inner, stop_at, 0

    def fit(self, rows, params):
        self.fits += 1
        if self.stop_at == self.fits:
            raise RuntimeError("driver lost")
        return self.inner.fit(rows, params)


def test_a_search_goes_on_where_it_was_cut_off(spark, features):
    tree = M.outcome_estimator("rf", numTrees=1, bootstrap=False, featureSubsetStrategy="all")
    grid = [{tree.maxDepth: 1}, {tree.maxDepth: 4}]
    rows, path = prepared_rows(features), shared_path(spark, "cut-off")
    broken = Counting(tree, stop_at=4)
    with pytest.raises(RuntimeError):
        M.grid_search(rows, broken, grid, 3, parallelism=1, path=path)
    rest = Counting(tree)
    results, models = M.grid_search(rows, rest, grid, 3, parallelism=1, path=path)
    assert broken.fits >= 4 and rest.fits == 3
    whole, _ = M.grid_search(rows, tree, grid, 3)
    assert sorted(map(tuple, results.collect())) == sorted(map(tuple, whole.collect()))
    assert results.agg(F.sum("rows")).first()[0] == 900 * 2
    again = Counting(tree)
    M.grid_search(rows, again, grid, 3, path=path)
    assert again.fits == 0 and set(models) == {0, 1}
    with pytest.raises(ValueError, match="another search"):
        M.grid_search(rows, tree, [{tree.maxDepth: 2}], 3, path=path)


def test_accuracy_counts_hits(spark, features):
    model = M.fit_outcomes(features, M.outcome_estimator("rf", numTrees=3, maxDepth=5))
    scored = model.transform(features)
    matrix = {(r.label, r.guess): r.n for r in M.confusion(scored).collect()}
    assert sum(matrix.values()) == 900
    assert M.accuracy(scored) == sum(n for (a, b), n in matrix.items() if a == b) / 900
    assert M.accuracy(scored.limit(0)) is None


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_equal_means_tie_whatever_the_order_of_the_folds(spark, partitions):
    shares = [(1, 10), (2, 10), (3, 10), (7, 10), (1, 3)]
    rows = []
    for index in range(12):
        turned = shares[index % 5:] + shares[: index % 5]
        rows += [(index, f"set {index}", fold, n, of) for fold, (n, of) in enumerate(turned)]
    rows += [(12, "less", fold, n, of) for fold, (n, of) in enumerate([(0, 10), *shares[1:]])]
    results = spark.createDataFrame(rows, "param_idx int, params string, fold int, hits long, rows long")
    means = M.mean_accuracy(results.repartition(partitions, "fold"))
    assert means.select("average_test_accuracy").distinct().count() == 2
    assert M.best_parameters(means).first().param_idx == 0


def test_one_booster_answers_for_two_outcomes(spark, features):
    two = features.withColumn("events", F.when(F.col("plate_z") < 2, F.lit("ball")).otherwise(F.lit("strike")))
    model = M.fit_outcomes(two, M.outcome_estimator("ovr_gbt", maxIter=3, maxDepth=2))
    assert len(model.stages[-1].stages) == 1
    assert hit_rate(two, model) == 1.0


def test_first_of_equal_parameter_sets_wins(spark):
    means = spark.createDataFrame(
        [(0, "a", 0.4), (1, "b", 0.6), (2, "c", 0.6)],
        "param_idx int, params string, average_test_accuracy double",
    )
    assert M.best_parameters(means).first().param_idx == 1


def test_input_trees_fit_equal_rows_once(spark, monkeypatch):
    """The rows differ by side alone, so a tree is fitted on two; it adds its side and no vectors.

    Of more than 10,000 rows the splits would be found on a sample, and not in the middle.
    """
    fitted = []

    def counted(df, name):
        fitted.append(written(df, name))
        return fitted[-1]

    monkeypatch.setattr(queries, "written", counted)
    model = queries._input_trees(spark.range(20001).withColumnRenamed("id", "event_id"))
    assert [sorted(map(tuple, df.collect())) for df in fitted] == [[(0, 10001.0), (1, 10000.0)]]
    sides = [{c: at + d for c, at in queries.INPUT_SPLITS.items()} for d in (-0.01, 0.01)]
    answered = model.transform(spark.createDataFrame(sides).select(K.FEATURES))
    above = [f"above_{c}" for c in K.FEATURES]
    assert answered.columns == [*K.FEATURES, "features", *above]
    assert [tuple(r) for r in answered.select(above).orderBy(above[0]).collect()] == [(0.0,) * 21, (1.0,) * 21]
