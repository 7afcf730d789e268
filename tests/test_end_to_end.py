"""From a pitch file to recommendations, through files at every step."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from diamondframe import schemas
from diamondframe.operators import candidates, model, training
from diamondframe.operators.pitches import relevant_pitches
from diamondframe.plans.prepare import handoff_tables
from diamondframe.plans.recommend import recommend, scored_candidates, thrown
from diamondframe.session import shared_path
from diamondframe.sources.models import load_model, save_model
from diamondframe.sources.pitches import pitch_table, read_pitches
from diamondframe.sources.tables import read_table, read_training, write_tables
from conftest import SF

NAMES = ["re288", "ind_hitter_sum", "generic_hitter_sum", "ind_pitcher_sum"]


@pytest.fixture(scope="module")
def season(spark):
    path = shared_path(spark, "season")
    source = pitch_table(spark, SF).select(*schemas.PITCHES.names)
    source.coalesce(1).write.options(header=True, nullValue="NULL").csv(path)
    return read_pitches(spark, path)


@pytest.fixture(scope="module")
def prepared(spark, season):
    folder = shared_path(spark, "tables")
    write_tables(handoff_tables(season), folder)
    features = training.feature_columns(read_training(spark, folder))
    forest = model.outcome_estimator("rf", numTrees=3)
    best, means = model.select_model(features, forest, [{forest.maxDepth: 3}], folds=2)
    assert [r.best for r in means.collect()] == [True]
    save_model(best, f"{folder}/model")
    tables = {name: read_table(spark, folder, name) for name in NAMES}
    requests = candidates.requests_from_pitches(
        relevant_pitches(season), "game_inning_ab_pitch"
    )
    return requests, load_model(f"{folder}/model"), tables


def test_the_file_gives_the_same_pitches(spark, season):
    source = pitch_table(spark, SF).select(*schemas.PITCHES.names)
    assert season.count() == 10_000 and season.exceptAll(source).count() == 0


def test_recommended_is_the_least_of_the_scored(prepared):
    requests, fitted, tables = prepared
    some = requests.filter("outs = 2 and balls = 3").cache()
    scored = scored_candidates(some, fitted, tables, seed=1)
    least = scored.groupBy("request_id").agg(F.min("expected_runs").alias("least"))
    chosen = recommend(some, fitted, tables, seed=1)
    joined = chosen.join(least, "request_id")
    assert joined.count() == some.count() > 100
    assert joined.filter("abs(expected_runs - least) > 1e-8").count() == 0
    counts = {r["n"] for r in scored.groupBy("request_id", "pitch_type_condensed")
              .agg(F.count("*").alias("n")).collect()}
    assert counts == {15, 25}


def test_chosen_pitches_can_be_thrown(prepared):
    requests, fitted, tables = prepared
    chosen = recommend(requests, fitted, tables, seed=1)
    after = thrown(requests.join(chosen, "request_id"), fitted, tables, seed=2)
    assert after.count() == chosen.count()
    assert after.filter("next_outs < 0 or next_outs > 3 or next_state is null").count() == 0
    missed = after.join(chosen.withColumnRenamed("plate_x", "target"), "request_id")
    spread = missed.agg(F.stddev_samp(F.col("target") - missed["plate_x"])).first()[0]
    assert spread == pytest.approx(0.4, abs=0.03)


def test_event_runs_raise_the_expectation(prepared):
    requests, fitted, tables = prepared
    full = requests.filter("b1 = 1 and b2 = 1 and b3 = 1")
    plain = recommend(full, fitted, tables, seed=1)
    runs = recommend(full, fitted, tables, seed=1, include_event_runs=True)
    both = plain.select("request_id", F.col("expected_runs").alias("plain")).join(runs, "request_id")
    assert both.count() > 10 and both.filter("expected_runs < plain").count() == 0
