"""The session store under crashes, reruns and refusals; settled sessions of a stream."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paceline.streaming import settled, store

KEY = "year int, round int, session string"


def keys(spark, *rows):
    return spark.createDataFrame(list(rows), KEY)


@pytest.fixture
def delivered(spark):
    laps = spark.createDataFrame([(2024, 1, "race", "a", 1.0), (2024, 1, "race", "b", 2.0), (2024, 2, "race", "a", 3.0), (2024, 2, "race", None, 3.0)], f"{KEY}, driver string, seconds double")
    weather = spark.createDataFrame([(2024, 1, "race", 20.0), (2024, 2, "race", 21.0), (2024, 3, "race", 22.0)], f"{KEY}, air double")
    return {"laps": laps, "weather": weather}


def allowed(spark, *rows):
    return spark.createDataFrame(list(rows), f"{KEY}, table string")


def files_of(path):
    return sorted(str(p) for p in path.rglob("*.parquet"))


class Crash(RuntimeError):
    pass


def stops_after(step):
    def after(s):
        if s == step:
            raise Crash(step)

    return after


SESSIONS = ((2024, 1, "race"), (2024, 2, "race"), (2024, 3, "race"))
REQUIRED = {"laps": ("driver",)}


def test_sessions_are_whole_or_refused(spark, tmp_path, delivered):
    root = str(tmp_path)
    got = {r.round: r for r in store.ingest(spark, root, delivered, keys(spark, *SESSIONS), allowed(spark), REQUIRED).collect()}
    assert got[1].refused == [] and got[1].counts == {"laps": 2, "weather": 1} and got[1].missing == []
    assert got[2].refused == ["laps: 1 incomplete rows"] and got[3].refused == ["laps: empty"] and got[3].missing == ["laps"]
    assert [(r.round, r.counts["laps"]) for r in store.ledger(spark, root).collect()] == [(1, 2)]
    assert {r["round"] for r in store.stored(spark, root, "weather").collect()} == {1}


def test_what_is_refused_is_tried_again_and_what_is_done_is_not(spark, tmp_path, delivered):
    root = str(tmp_path)
    store.ingest(spark, root, delivered, keys(spark, *SESSIONS), allowed(spark), REQUIRED)
    more = delivered | {"laps": delivered["laps"].filter("driver IS NOT NULL").withColumn("seconds", F.col("seconds") + 100)}
    tried = store.ingest(spark, root, more, keys(spark, *SESSIONS), allowed(spark, (2024, 3, "race", "laps")), REQUIRED)
    assert {r.round for r in tried.collect()} == {2, 3}
    assert {r.round: (r.counts["laps"], r.missing) for r in store.ledger(spark, root).collect()} == {1: (2, []), 2: (1, []), 3: (0, ["laps"])}
    # the first session keeps what was written of it
    assert sorted((r["round"], r.seconds) for r in store.stored(spark, root, "laps").collect()) == [(1, 1.0), (1, 2.0), (2, 103.0)]
    before = files_of(tmp_path)
    assert store.ingest(spark, root, more, keys(spark, *SESSIONS, *SESSIONS), allowed(spark), REQUIRED).isEmpty()
    assert files_of(tmp_path) == before


@pytest.mark.parametrize("step", ["staged", "validated", "written"])
def test_a_crash_leaves_no_mark_and_a_rerun_repairs(spark, tmp_path, delivered, step):
    root = str(tmp_path)
    with pytest.raises(Crash):
        store.ingest(spark, root, delivered, keys(spark, SESSIONS[0]), allowed(spark), after=stops_after(step))
    assert store.ledger(spark, root).isEmpty()
    if step == "written":
        assert store.stored(spark, root, "laps").isEmpty()  # rows without a mark aren't seen
    other = delivered | {"laps": delivered["laps"].filter("driver = 'b'"), "weather": delivered["weather"].limit(0)}
    store.ingest(spark, root, other, keys(spark, SESSIONS[0]), allowed(spark, (2024, 1, "race", "weather")))
    assert [(r.counts["laps"], r.missing) for r in store.ledger(spark, root).collect()] == [(1, ["weather"])]
    assert [r.driver for r in store.stored(spark, root, "laps").collect()] == ["b"]
    if step == "written":
        assert store.stored(spark, root, "weather").isEmpty()  # what the stopped run wrote of it doesn't come back


def test_a_run_of_the_same_name_replaces_its_marks(spark, tmp_path, delivered):
    root = str(tmp_path)
    with pytest.raises(Crash):
        store.ingest(spark, root, delivered, keys(spark, SESSIONS[0]), allowed(spark), batch="7", after=stops_after("marked"))
    store.ingest(spark, root, delivered, keys(spark, SESSIONS[0]), allowed(spark), batch="7")
    assert store.ledger(spark, root).count() == 1


def test_announced_sessions_as_a_stream(spark, tmp_path, delivered):
    root, news, state = (str(tmp_path / x) for x in ("root", "news", "state"))
    run = lambda tables=delivered, **kw: store.ingest_announced(spark, root, news, lambda: tables, allowed(spark), state, REQUIRED, **kw)
    keys(spark, SESSIONS[0], SESSIONS[2]).write.parquet(news)
    with pytest.raises(Exception, match="written"):
        run(after=stops_after("written"))
    assert store.ledger(spark, root).isEmpty()
    assert run() == 1 and run() == 0
    keys(spark, SESSIONS[1], SESSIONS[0]).write.mode("append").parquet(news)
    assert run() == 0  # refused
    repaired = {"laps": delivered["laps"].na.fill("x").unionByName(spark.createDataFrame([(2024, 3, "race", "c", 1.0)], delivered["laps"].schema)), "weather": delivered["weather"]}
    assert run(repaired) == 2  # nothing new was announced, but both that were refused pass now
    assert sorted(r.round for r in store.ledger(spark, root).collect()) == [1, 2, 3]


def test_the_query_joins_lines_and_facts_once(spark, monkeypatch):
    """Laps, weather and the list of sessions come from the same written lines, all results from one league."""
    from paceline.plans import queries
    from paceline.sources import championship, league

    read = []
    for module in (championship, league):
        monkeypatch.setattr(module, "table", lambda s, d, name, of=module.table: read.append(name) or of(s, d, name))
    assert not queries.QUERIES["session_ingest"](spark, "/root/testdata/sf0.001").isEmpty()
    assert read.count("lineitem") == 1 and read.count("orders") == 2


# --- settled sessions


ROWS = "event_id long, session string, start timestamp, ts timestamp, driver string"
T0 = dt.datetime(2024, 1, 1, 10)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_sessions_settle(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", settled.ROCKS)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def add(*rows):
        spark.createDataFrame([(i, s, hours(st), hours(t), d) for i, s, st, t, d in rows], ROWS).coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        q = settled.settled_sessions(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.session: r for r in spark.read.schema(settled.OUT).parquet(out).collect()}

    try:
        add((1, "one", 0, 0.1, "a"), (2, "one", 0, 0.2, "b"), (2, "one", 0, 0.2, "b"), (3, None, 0, 0.2, "b"), (9, "early", 20, 0.3, "z"))
        assert run() == {}  # nothing has settled, a session that starts later is waited for
        add((1, "one", 0, 0.1, "a"), (4, "one", 0, 5.0, "a"))  # a repeated row and a late one
        assert run() == {}
        add((5, "two", 7, 13.1, "c"))  # event time reaches 13.1 h; the watermark trails by six hours
        got = run()
        assert set(got) == {"one"}
        one = got["one"]
        assert (one.rows, one.entrants, one.started, one.first, one.last) == (3, 2, hours(0), hours(0.1), hours(5))
        add((6, "one", 0, 3.0, "x"))  # too late: the session was given out
        add((7, "three", 40, 40.0, None))
        got = run()
        assert set(got) == {"one", "two", "early"} and got["one"].rows == 3 and got["two"].rows == 1 and got["early"].rows == 1
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
