"""What the plans must look like for a table of any size and any skew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from diamondframe.operators import candidates, expected, lookups, profiles, runs, training
from diamondframe.operators.pitches import inning_runs, labelled_pitches, relevant_pitches
from diamondframe.plans.prepare import profile_tables
from diamondframe.plans.queries import LABELS, all_queries
from diamondframe.session import written
from diamondframe.sources.pitches import pitch_table, pitches_from_events
from conftest import SF


@pytest.fixture
def relevant(spark):
    return relevant_pitches(pitch_table(spark, SF))


@pytest.fixture
def settings(spark):
    """Change settings for one test."""
    before = {}

    def change(**values):
        for name, value in values.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    execution = df._jdf.queryExecution()
    df.collect()
    return execution.executedPlan().toString()


def test_filters_and_columns_reach_the_files(relevant, capsys):
    runs.run_expectancy(relevant).explain("formatted")
    lines = capsys.readouterr().out.splitlines()
    pushed = next(line for line in lines if line.startswith("PushedFilters"))
    assert "LessThan(inning,10)" in pushed and "LessThan(strikes,3)" in pushed
    read = next(line for line in lines if line.startswith("ReadSchema"))
    assert "bat_score" in read and "release_speed" not in read and "pitcher" not in read


def test_training_table_shuffles_no_pitch_while_profiles_are_small(relevant):
    tables = profile_tables(relevant)
    table = training.training_table(
        labelled_pitches(relevant), tables["ind_hitter_sum"], tables["generic_hitter_sum"]
    )
    plan = plan_of(table)
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan


def test_training_table_joins_by_shuffle_when_profiles_are_large(relevant, settings):
    tables = profile_tables(relevant)
    small = training.training_table(
        labelled_pitches(relevant), tables["ind_hitter_sum"], tables["generic_hitter_sum"]
    )
    want = sorted(map(str, small.collect()))
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    large = training.training_table(
        labelled_pitches(relevant), tables["ind_hitter_sum"], tables["generic_hitter_sum"]
    )
    assert "SortMergeJoin" in plan_of(large)
    assert sorted(map(str, large.collect())) == want


def test_oversized_half_inning_is_split_by_the_skew_join(spark, relevant, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    hot = relevant.withColumn(
        "game_inning", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("game_inning"))
    )
    attached = inning_runs(hot.repartition(16))
    assert "skew=true" in final_plan(attached)
    highest = hot.filter("game_inning = 'hot'").agg(F.max("bat_score")).first()[0]
    found = attached.filter("game_inning = 'hot'").select("post_inning_runs").distinct().collect()
    assert [r[0] for r in found] == [highest]
    assert attached.count() == relevant.count()


def test_run_values_use_one_wide_shuffle(relevant):
    expectancy = written(runs.run_expectancy(relevant), "re288")
    plan = plan_of(runs.run_values(relevant, expectancy).select("event_id", "delta_re"))
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Besides the shuffle into ranges, which has been written; one row per range is joined.
    assert len(wide) <= 3 and all("_range" in line for line in wide)


def test_best_pitch_shuffles_requests_only(spark):
    plan = plan_of(all_queries()["best_pitch"](spark, SF))
    lines = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    by_request = [line for line in lines if "request_id" in line]
    assert len(by_request) == 1 and "REPARTITION_BY_NUM" in by_request[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["run_expectancy", "hitter_profiles", "pitcher_profiles"])
def test_groups_are_reduced_before_the_shuffle(spark, name):
    plan = plan_of(all_queries()[name](spark, SF))
    # Reading from the files up, the first shuffle comes after a partial aggregate.
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "partial_" in below


def test_no_query_multiplies_rows_without_keys(spark):
    for name, query in all_queries().items():
        if name in {"cv_results", "outcome_scores", "recommend", "thrown_pitches"}:
            continue
        plan = plan_of(query(spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_results_do_not_depend_on_the_partitioning(spark, relevant, settings):
    def results():
        expectancy = written(runs.run_expectancy(relevant), "re288")
        values = runs.run_values(relevant, expectancy).select("event_id", F.round("delta_re", 9))
        sums = profiles.hitter_profiles(profiles.hitter_sums(relevant)).select(
            *profiles.HITTER_KEYS, F.round("avgEV", 9)
        )
        return [sorted(map(str, df.collect())) for df in (values, sums)]

    want = results()
    settings(spark__sql__shuffle__partitions="1")
    assert results() == want
    settings(spark__sql__shuffle__partitions="31")
    assert results() == want


def test_next_values_are_288_rows(relevant):
    expectancy = written(runs.run_expectancy(relevant), "re288")
    assert expected.next_state_values(expectancy, LABELS).count() == 288


def test_spread_gives_every_task_its_share(spark, relevant):
    requests = candidates.spread(candidates.requests_from_pitches(relevant, "event_id"))
    sizes = [r["count"] for r in requests.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes)


def test_least_and_last_are_found_without_a_sort(spark):
    """Neither the best of all candidates nor the last row of a key sorts what it reduces."""
    plan = plan_of(all_queries()["best_pitch"](spark, SF))
    assert "SortAggregate" not in plan and "Sort [" not in plan and "HashAggregate" in plan
    rows = relevant_pitches(pitch_table(spark, SF)).select("pitcher", "event_id", "description")
    plan = plan_of(lookups.keyed_lookup(rows, ["pitcher"], ["event_id"]))
    assert "SortAggregate" not in plan
    # The few rows left are reduced before the shuffle too.
    assert "HashAggregate" in plan[plan.rindex("Exchange hashpartitioning"):]


def test_the_pitch_table_is_read_by_many_tasks(spark):
    assert pitch_table(spark, SF).rdd.getNumPartitions() > 1


def test_pitches_of_one_small_file_are_made_in_parallel(spark, tmp_path):
    events = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "id * 0.25D AS value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    made = pitches_from_events(spark, str(tmp_path))
    assert made.select(F.spark_partition_id()).distinct().count() > 1
    assert made.count() == 400
