"""Every registered query that SQL can express, against DuckDB on the given tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from compare import compare, duckdb_over
from conftest import SF, SMALL
from diamondframe.plans.queries import all_queries as queries
from diamondframe.operators.pitches import relevant_pitches
from diamondframe.sources.pitches import pitch_table
from oracles import ORACLES

FITTED = {"cv_results", "outcome_scores", "recommend", "thrown_pitches"}


@pytest.fixture(scope="module")
def con():
    return duckdb_over(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    found = compare(spark, con, queries()[name], ORACLES[name], SF)
    assert found["types"] is True and found["equal"], found
    assert found["rows"][0] > 0


def test_only_queries_with_a_fitted_model_lack_sql():
    assert set(queries()) - set(ORACLES) == FITTED
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 610


@pytest.mark.parametrize("name", ["run_values", "hitter_profiles", "best_pitch"])
def test_smallest_data_runs(spark, name):
    queries()[name](spark, SMALL).collect()


def test_recommendation_per_request(spark):
    got = queries()["recommend"](spark, SF)
    rows = got.collect()
    assert len({r.request_id for r in rows}) == len(rows) == relevant_pitches(pitch_table(spark, SF)).count()
    assert all(0 <= r.expected_runs < 20 for r in rows if r.reason is None)
    assert all((r.expected_runs is None) == (r.reason is not None) for r in rows)
    assert sum(r.reason is None for r in rows) > 6000


def test_thrown_pitches_move_the_state(spark):
    got = queries()["thrown_pitches"](spark, SF)
    assert got.count() == relevant_pitches(pitch_table(spark, SF)).count()
    assert got.filter("reason is null and (drawn_event is null or next_state is null)").count() == 0
    assert got.filter("reason is not null and state is not null").count() == 0
    assert got.filter("state <> next_state").count() > 0


def test_search_results(spark):
    rows = queries()["cv_results"](spark, SF).collect()
    assert len(rows) == 4 and sum(r.best for r in rows) == 1
    best = max(r.average_test_accuracy for r in rows)
    assert next(r for r in rows if r.best).average_test_accuracy == best


def test_scores_sum_to_one(spark):
    got = queries()["outcome_scores"](spark, SF)
    bad = "abs(aggregate(map_values(event_probs), 0D, (a, p) -> a + p) - 1) > 1e-9"
    assert got.count() > 5000 and got.filter(bad).count() == 0
