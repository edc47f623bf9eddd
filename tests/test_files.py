from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.functions import scalars
from paceline.sources import files
from paceline.streaming.ingest import ingest_available


def test_session_files(spark, tmp_path):
    path = str(tmp_path / "raw")
    laps = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "driver string, seconds double")
    for rnd in (1, 2):
        files.write_sessions(files.prepared(laps, 2024, rnd, "race"), path)
    files.write_sessions(files.prepared(laps.limit(1), 2024, 2, "race"), path)  # a rerun replaces its own partition only
    read = files.read_sessions(spark, path, "driver string, seconds double, wind double", "race")
    assert sorted((r.round, r.driver, r.wind) for r in read.collect()) == [(1, "a", None), (1, "b", None), (2, "a", None)]
    assert files.no_nan(read).filter("seconds IS NULL").count() == 1
    assert files.read_events(spark, path, "driver string", 2024, 9, "race").isEmpty()
    with pytest.raises(FileNotFoundError):
        files.read_sessions(spark, path, "driver string", "quali")


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "done")
    files.write_marker(path, 2024, 1, "race", {"laps": 3}, ["weather"], "now")
    files.write_marker(path, 2024, 2, "practice_1", {}, [], "now")
    (tmp_path / "done" / "2024_3_race.json").write_text("{not json")
    got = {(r.round, r.session): r for r in files.read_ledger(spark, path).collect()}
    assert got[1, "race"].counts == {"laps": 3} and got[3, "race"].unreadable and not got[2, "practice_1"].unreadable
    allowed = spark.createDataFrame([], "year int, round int, session string, table string")
    assert files.unexpected_gaps(files.read_ledger(spark, path), allowed).count() == 1


def test_log_and_params(spark, tmp_path):
    path = str(tmp_path / "log")
    for i, m in enumerate((0.5, 0.7, 0.7)):
        files.append_log(spark.createDataFrame([(i, "m", m)], "trial_id int, model string, metric double"), path)
    log = files.read_log(spark, path, "trial_id int, model string, metric double")
    assert [r.trial_id for r in files.best_trial(log, "metric", "model").collect()] == [1]
    assert files.read_params(str(tmp_path / "none.json")) == {}


def test_ingest_is_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(3).write.parquet(source)
    assert ingest_available(spark, source, "id bigint", target, state) == 3
    spark.range(2).write.mode("append").parquet(source)
    assert ingest_available(spark, source, "id bigint", target, state) == 2
    assert spark.read.parquet(target).count() == 5


def test_scalars(spark):
    t = spark.createDataFrame([("São Paulo -- GP", "1\n"), ("__A b", "R"), (None, None)], "a string, b string")
    got = [tuple(r) for r in t.select(scalars.circuit_id(F.col("a")), scalars.slugify(F.col("a")), scalars.dnf_flag(F.col("b"))).collect()]
    assert got == [("sao_paulo_gp", "s_o_paulo_gp", True), ("a_b", "a_b", True), (None, None, True)]


def test_markers_replace_one_another(spark, tmp_path):
    path = f"file://{tmp_path}/done"
    for n in (1, 2):
        files.write_marker(path, 2024, 1, "race", {"laps": n}, [], "now")
    assert [r.counts for r in files.read_ledger(spark, path).collect()] == [{"laps": 2}]


def test_spans_of_time_and_expectations(spark):
    t = spark.createDataFrame([(1_500_000_000, 0.0), (None, 400.0), (-250_000_000, -400.0)], "ns long, d double")
    got = t.select(files.seconds("ns").alias("s"), scalars.elo_expectation(F.col("d")).alias("e")).collect()
    assert [r.s for r in got] == [1.5, None, -0.25] and [r.e for r in got] == pytest.approx([0.5, 1 / 11, 10 / 11])
