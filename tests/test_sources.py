from __future__ import annotations

import pytest
from pyspark.sql import Observation, functions as F

from diamondframe import schemas
from diamondframe.operators.pitches import relevant_pitches
from diamondframe.plans.prepare import handoff_tables
from diamondframe.session import shared_folder, shared_path, written
from diamondframe.sources.pitches import headers, null_sentinel, pitch_table, read_pitches
from diamondframe.sources.tables import current_set, read_table, read_tables, read_training, write_tables
from conftest import SMALL
from diamondframe.constants import HitterThresholds, PitcherThresholds
from frames import PLAIN, collected, pitches


def test_pitches_from_text(spark, tmp_path):
    names = list(reversed(schemas.PITCHES.names)) + ["unused"]
    rows = [
        {**PLAIN, "on_1b": "NULL", "events": "NULL", "release_speed": "NA", "bat_score": "",
         "unused": "x"},
        {**PLAIN, "on_1b": "123", "events": "single", "unused": "NULL"},
    ]
    lines = [",".join(names)] + [
        ",".join("NULL" if r[n] is None else str(r[n]) for n in names) for r in rows
    ]
    (tmp_path / "pitches.csv").write_text("\n".join(lines) + "\n")
    got = read_pitches(spark, str(tmp_path / "pitches.csv"))
    assert got.schema == schemas.PITCHES
    first, second = got.collect()
    assert (first.on_1b, first.events, first.release_speed, first.bat_score) == (None,) * 4
    assert (second.on_1b, second.events, second.pitcher) == ("123", "single", 10)
    assert relevant_pitches(got).count() == 2


def _write(folder, name, columns, rows):
    lines = [",".join(columns)] + [",".join("" if r.get(c) is None else str(r[c]) for c in columns) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_each_file_has_its_own_header(spark, tmp_path):
    names = schemas.PITCHES.names
    _write(tmp_path, "a.csv", names, [{**PLAIN, "game_pk": 1}])
    _write(tmp_path, "b.csv", ["more", *reversed(names)], [{**PLAIN, "game_pk": "2.0", "more": "x", "batter": " 7.0 "}])
    got = {r.game_pk: r for r in read_pitches(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[2].batter == 7
    assert got[1].inning == got[2].inning and got[1].home_team == got[2].home_team
    assert relevant_pitches(read_pitches(spark, str(tmp_path))).count() == 2


@pytest.mark.parametrize("value", ["seven", "7.5", "1e3x"])
def test_unreadable_numbers_are_an_error(spark, tmp_path, value):
    _write(tmp_path, "a.csv", schemas.PITCHES.names, [{**PLAIN, "inning": value}])
    with pytest.raises(Exception, match="inning: not a whole number"):
        read_pitches(spark, str(tmp_path)).collect()


def test_a_file_without_a_column_is_refused(spark, tmp_path):
    _write(tmp_path, "a.csv", schemas.PITCHES.names[1:], [PLAIN])
    with pytest.raises(ValueError, match="no column game_pk"):
        read_pitches(spark, str(tmp_path))


def test_pitches_from_parquet(spark):
    path = shared_path(spark, "pitches_test")
    pitches(spark, dict(on_3b="NULL")).write.parquet(path)
    assert read_pitches(spark, path, "parquet").first().on_3b is None


def test_sentinel_touches_text_only(spark):
    df = spark.createDataFrame([("NULL", 1, "null"), ("x", 2, "NULL")], "a string, b int, c string")
    assert collected(null_sentinel(df), "b") == [
        dict(a=None, b=1, c="null"), dict(a="x", b=2, c=None),
    ]


def test_handoff_tables_survive_both_formats(spark):
    source = pitch_table(spark, SMALL)
    tables = handoff_tables(source, HitterThresholds(50, 3, 1), PitcherThresholds(50, 0.03))
    assert set(tables) == set(schemas.TABLES)
    folder = shared_path(spark, "handoff")
    for fmt in ("csv", "parquet"):
        write_tables(tables, f"{folder}/{fmt}", fmt)
        write_tables(tables, f"{folder}/{fmt}", fmt)  # replaces
    for name, schema in schemas.TABLES.items():
        text = read_table(spark, f"{folder}/csv", name, "csv")
        columns = read_table(spark, f"{folder}/parquet", name)
        assert text.columns == columns.columns == schema.names
        assert text.count() == tables[name].count() > 0
        assert text.exceptAll(columns).count() == 0
    training = read_training(spark, f"{folder}/parquet")
    assert 0 < training.count() < read_table(spark, f"{folder}/parquet", "model_data").count()
    assert training.filter("events is null").count() == 0


def test_text_table_from_elsewhere(spark, tmp_path):
    (tmp_path / "re288.csv").write_text(
        '"","out_base_count_state","runs_expected","occurrences"\n'
        '"1","0_000_00",0.48,12\n"2","0_000_01",NA,3\n'
    )
    got = collected(read_table(spark, str(tmp_path), "re288", "csv", ".csv"), "occurrences")
    assert got == [
        dict(out_base_count_state="0_000_01", runs_expected=None, occurrences=3),
        dict(out_base_count_state="0_000_00", runs_expected=0.48, occurrences=12),
    ]


def test_written_tables_go_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    table = written(spark.range(3), "three")
    assert all(folder in path for path in table.inputFiles()) and table.count() == 3


def test_one_job_reads_the_headers_of_many_files(spark, tmp_path):
    names = schemas.PITCHES.names
    for k in range(40):
        _write(tmp_path, f"part [{k:02d}]%.csv", names if k % 3 else ["more", *names], [{**PLAIN, "game_pk": k}])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "mark.csv").write_text("\ufeff" + ",".join(names) + "\n" + ",".join("" if PLAIN[n] is None else str(PLAIN[n]) for n in names) + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "first lines")
    found = headers(spark, str(tmp_path))
    jobs = tracker.getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert {len(files) for files in found.values()} == {14, 27}
    got = read_pitches(spark, str(tmp_path))
    assert got.count() == 41 and {r.game_pk for r in got.collect()} == set(range(40))


def test_no_files_and_doubled_columns(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_pitches(spark, str(tmp_path)).schema == schemas.PITCHES
    assert read_pitches(spark, str(tmp_path)).collect() == []
    names = schemas.PITCHES.names
    _write(tmp_path, "a.csv", ["extra", *names, "extra"], [{**PLAIN, "extra": "x"}])
    assert read_pitches(spark, str(tmp_path)).first().game_pk == PLAIN["game_pk"]


def _states(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.TABLES["re288"])


def test_tables_are_replaced_as_one_set(spark):
    folder = shared_path(spark, "sets")
    assert current_set(spark, folder) is None
    hitters = spark.createDataFrame([], schemas.TABLES["ind_hitter_sum"])
    first = write_tables({"re288": _states(spark, ("0_000_00", 0.5, 3)), "ind_hitter_sum": hitters}, folder)
    broken = spark.range(1).select(
        *[F.raise_error(F.lit("lost")).cast(f.dataType).alias(f.name) for f in hitters.schema]
    )
    with pytest.raises(Exception, match="lost"):
        write_tables({"re288": _states(spark, ("0_000_00", 9.9, 9)), "ind_hitter_sum": broken}, folder)
    # The job that died has written one table of two; the old set is still the one in force.
    assert current_set(spark, folder)["version"] == first
    assert read_table(spark, folder, "re288").first().runs_expected == 0.5
    before = read_tables(spark, folder, ["re288", "ind_hitter_sum"])
    second = write_tables({"re288": _states(spark, ("0_000_00", 0.7, 4))}, folder)
    assert second > first and current_set(spark, folder)["names"] == ["re288"]
    assert read_table(spark, folder, "re288").first().runs_expected == 0.7
    assert before["re288"].first().runs_expected == 0.5
    with pytest.raises(ValueError, match="holds re288 as parquet, not ind_hitter_sum"):
        read_table(spark, folder, "ind_hitter_sum")
    with pytest.raises(ValueError, match="not re288 as csv"):
        read_table(spark, folder, "re288", "csv")


def test_unreadable_values_are_an_error_or_counted(spark, tmp_path):
    (tmp_path / "re288.csv").write_text(
        "out_base_count_state,runs_expected,occurrences\n0_000_00,0.48,12.0\n0_000_01,x.5,3\n"
        "0_000_02,NA,many\n0_000_10,,7.5\n"
    )
    with pytest.raises(Exception, match="re288.(runs_expected|occurrences): not a number"):
        read_table(spark, str(tmp_path), "re288", "csv", ".csv").collect()
    report = Observation("re288")
    got = collected(read_table(spark, str(tmp_path), "re288", "csv", ".csv", report), "out_base_count_state")
    assert [(r["runs_expected"], r["occurrences"]) for r in got] == [(0.48, 12), (None, 3), (None, None), (None, None)]
    assert report.get == {"rows": 4, "unreadable_runs_expected": 1, "unreadable_occurrences": 2}


def test_training_rows_report_what_they_lack(spark):
    folder = shared_path(spark, "reported")
    schema = schemas.TABLES["model_data"]
    full = {f.name: {"string": "x", "bigint": 1, "double": 1.0}[f.dataType.simpleString()] for f in schema}
    rows = [full, {**full, "avgEV": None}, {**full, "avgEV": float("nan"), "events": None}, {**full, "prof_stand": None}]
    table = spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)
    write_tables({"model_data": table}, folder)
    report = Observation("training")
    kept = read_training(spark, folder, report=report)
    assert kept.count() == 2
    counts = report.get
    assert (counts["rows"], counts["kept"], counts["missing_avgEV"], counts["missing_events"], counts["missing_batter"]) == (4, 2, 2, 1, 0)
    assert "missing_prof_stand" not in counts
