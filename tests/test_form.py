"""Features by hand-worked cases, and that they don't see the future."""

from __future__ import annotations

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from paceline.operators import circuits, dimensions, evaluation, form, models, sessions, simulation
from paceline.plans import queries
from paceline.plans.oracles import ORACLE_SQL
from tests import compare

#: name, type, and what a row has unless a test says otherwise
FIELDS = [
    ("year", "int", None), ("round", "int", None), ("driver", "string", None), ("position", "double", 8.0), ("team", "string", "north"), ("no", "int", 1), ("code", "string", None), ("circuit", "int", 4),
    ("grid", "double", 7.0), ("quali", "double", 6.0), ("quali_gap", "double", 0.4), ("pace_gap", "double", 0.3), ("points", "double", 2.0), ("dnf", "boolean", False), ("race_ok", "boolean", True),
    ("wx_rain_frac", "double", 0.1), ("wx_air_temp", "double", 17.0), ("fp_best_gap", "double", 0.6), ("fp_last_gap", "double", 0.7),
]
COLUMNS = ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS)
NAMES = [name for name, _, _ in FIELDS]


def row(*given, **other):
    """Values by place for year, round, driver, position and team, others by name."""
    own = dict(zip(NAMES, given, strict=False)) | other
    own.setdefault("code", own["driver"].upper())
    return tuple(own.get(name, usual) for name, _, usual in FIELDS)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def pick(df, *columns, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_last_five_and_share(spark):
    rows = [row(2022, r, "a", float(r), points=10.0 * r, grid=0.0 if r == 7 else 3.0) for r in range(1, 8)] + [row(2022, r, "b", points=0.0) for r in range(1, 8)]
    got = form.driver_form(frame(spark, rows + [row(2022, 8, "a", None), row(2022, 8, "b")]))
    assert pick(got, "drv_finish_l5", "drv_n_l5", "drv_grid_l5", "drv_pts_share_ytd", driver="a", round=8) == [(5.0, 5, 3.0, 1.0)]
    assert pick(got, "drv_finish_l5", "drv_n_l5", "drv_rounds_since_last", driver="a", round=1) == [(None, 0, None)]
    assert pick(got, "drv_pts_share_ytd", driver="b", round=8) == [(0.0,)]


def test_events_since_last_and_unusable_events(spark):
    rows = [row(2022, r, "b") for r in range(1, 6)] + [row(2022, 1, "a", 1.0), row(2022, 5, "a", 9.0)]
    got = form.driver_form(frame(spark, rows))
    assert pick(got, "drv_rounds_since_last", driver="a", round=5) == [(3,)]
    off = [row(2022, r, "a", float(r), race_ok=r != 2) for r in range(1, 4)]
    assert pick(form.driver_form(frame(spark, off)), "drv_finish_l5", round=3) == [(1.0,)]


def test_recency_weights(spark):
    gaps = [0.9, None, 0.2, 1.6]
    rows = [row(2019, i + 1, "k", quali_gap=g) for i, g in enumerate(gaps)] + [row(2019, 5, "k")]
    known = [(g, 0.5 ** ((4 - i) / 4)) for i, g in enumerate(gaps) if g is not None]
    want = sum(g * w for g, w in known) / sum(w for _, w in known)
    assert pick(form.recency_form(frame(spark, rows)), "drv_qgap_ew4", "team_qgap_ew4", round=5)[0] == pytest.approx((want, want))


def test_recency_of_a_long_history(spark):
    """Thousands of events, far beyond what powers of two from the first event would hold."""
    n = 2600
    gaps = [(i * 37 % 101) / 50 for i in range(n)]
    rows = [row(1900 + i // 50, i % 50 + 1, "k", quali_gap=g) for i, g in enumerate(gaps)]
    got = form.recency_form(frame(spark, rows)).orderBy("year", "round").toPandas()
    top = low = 0.0
    for i, g in enumerate(gaps):
        if i:
            assert got.drv_qgap_ew2[i] == pytest.approx(top / low, rel=1e-9)
        top, low = (top + g) * 0.5**0.5, (low + 1) * 0.5**0.5
    assert got.team_qgap_ew8.notna().sum() == n - 1


def test_teammate_gap(spark):
    given = {"p": ("east", 0.25), "q": ("east", 0.75), "r": ("east", 2.0), "s": ("west", 1.5), "u": ("west", None)}
    rows = [row(2019, 6, d, team=t, fp_best_gap=g) for d, (t, g) in given.items()]
    got = dict(pick(form.weekend_pace(frame(spark, rows)), "driver", "pq_fp_vs_teammate"))
    assert got == {"p": pytest.approx(0.25 - 1.375), "q": pytest.approx(0.75 - 1.125), "r": pytest.approx(2.0 - 0.5), "s": None, "u": None}


def test_threshold(spark):
    """The least number whose share of the field is not below the limit, whatever the rounding of the product."""
    from fractions import Fraction

    shares, sizes = [Fraction(1, k) for k in (2, 3, 4, 5, 7)] + [Fraction(3, 10), Fraction(9, 10)], range(1, 40)
    cases = [(float(s), n, min(k for k in range(n + 1) if k >= s * n)) for s in shares for n in sizes]
    table = spark.createDataFrame(cases, "share double, size int, want int")
    assert table.filter(F.ceil(F.col("size") * F.col("share") - 1e-9) != F.col("want")).isEmpty()
    assert [spark.range(1).select(circuits.threshold(F.lit(n), s)).first()[0] for s, n, _ in cases[::60]] == [w for *_, w in cases[::60]]


def test_circuit_shrinkage(spark):
    """One visit, a win from a mean of 3.0 over all earlier events, shrunk by three events of that mean."""
    rows = [row(2018, 4, "k", 1.0, circuit=9), row(2018, 9, "k", 5.0, circuit=2), row(2019, 4, "k", 2.0, circuit=9)]
    got = pick(circuits.circuit_history(frame(spark, rows)), "circ_drv_finish", "circ_drv_n", "circ_n_years", year=2019)
    assert got == [((1.0 + 3 * 3.0) / 4, 1, 1)]


@pytest.mark.parametrize("build", [form.driver_form, form.team_form, form.recency_form, circuits.circuit_history])
def test_features_ignore_the_future(spark, build):
    rows = [row(y, r, d, float((y * 7 + r * 3 + i * 5) % 6 + 1), circuit=r % 2, points=float(i), dnf=(y + r + i) % 4 == 0, race_ok=(y, r) != (2022, 2)) for y in (2021, 2022) for r in (1, 2, 3) for i, d in enumerate("abc")]
    whole = build(frame(spark, rows)).filter("year = 2021 OR round = 1").toPandas()
    past = build(frame(spark, [r for r in rows if r[0] == 2021 or r[1] == 1])).toPandas()
    keys = [c for c in ("year", "round", "driver", "team") if c in whole]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (whole, past))
    assert a.equals(b)


def test_stage_rules(spark):
    h = frame(spark, [row(2022, 1, "a")])
    with pytest.raises(ValueError):
        form.feature_table(h, "quali", ("scenario",))
    assert "grid" in form.feature_table(h, "finish").columns and "grid" not in form.feature_table(h, "quali").columns


def test_scoring_an_unseen_event(spark):
    h = frame(spark, [row(2022, 1, "a", 2.0), row(2022, 2, "a", 4.0)])
    entries = h.filter("round = 1").select(F.lit(2022).alias("year"), F.lit(3).alias("round"), "no", "driver", "code", "team", "circuit", "race_ok")
    assert pick(form.score_entries(h, entries, form.driver_form), "drv_finish_l5") == [(3.0,)]


def test_missing_flag_is_refused(spark):
    with pytest.raises(Exception, match="race_ok"):
        form.usable(frame(spark, [row(2022, 1, "a", race_ok=None)])).collect()


def test_empty_history(spark):
    empty = frame(spark, [])
    for build in (form.driver_form, form.team_form, form.recency_form, form.grid_features, circuits.circuit_history, dimensions.drivers, simulation.recent_dnf_rate):
        assert build(empty).isEmpty()


def metrics(spark, score, actual):
    n = len(score)
    s = spark.createDataFrame([("m", 2022, 1, f"d{i}", float(x)) for i, x in enumerate(score)], "model string, year int, round int, driver string, score double")
    a = spark.createDataFrame([(2022, 1, f"d{i}", float(x)) for i, x in enumerate(actual)], "year int, round int, driver string, position double")
    assert n == len(actual)
    return evaluation.race_metrics(s, a).first()


def test_metrics_under_ties(spark):
    n = 12
    m = metrics(spark, [1.0] * n, range(1, n + 1))
    assert (m.spearman, m.winner_acc, m.podium_overlap, m.top10_overlap) == (0.0, pytest.approx(1 / n), pytest.approx(3 / n), pytest.approx(10 / n))
    assert m.mae_position == pytest.approx((n * n - 1) / (3 * n))
    m = metrics(spark, [1, 1, 2, 3], [1, 2, 3, 4])
    assert (m.winner_acc, m.podium_overlap, m.mae_position) == (0.5, 1.0, 0.25)


def test_mean_distance_is_that_of_all_pairs_of_places(spark):
    cases = [(bp, tp, ba, ta) for bp in range(6) for tp in range(1, 6) for ba in range(6) for ta in range(1, 6)]
    x = spark.createDataFrame(cases, "bp int, tp int, ba int, ta int")
    got = x.select("bp", "tp", "ba", "ta", evaluation.mean_distance(*map(F.col, ("bp", "tp", "ba", "ta"))).alias("d")).collect()
    for bp, tp, ba, ta, d in got:
        assert d == pytest.approx(sum(abs(i - j) for i in range(bp + 1, bp + tp + 1) for j in range(ba + 1, ba + ta + 1)) / (tp * ta), abs=1e-12)


def test_mean_distance_of_large_ties_takes_no_work_by_place(spark):
    """20,000 rows of ties of a million places: summed place by place they would be 20 billion steps."""
    n = 1_000_000
    x = spark.range(20_000).select(F.lit(0).alias("bp"), F.lit(n).alias("tp"), F.col("id").cast("int").alias("ba"), F.lit(1).alias("ta"))
    began = time.monotonic()
    total = x.agg(F.sum(evaluation.mean_distance(*map(F.col, ("bp", "tp", "ba", "ta"))))).first()[0]
    assert total == pytest.approx(sum((k * (k + 1) + (n - 1 - k) * (n - k)) / (2 * n) for k in range(20_000)))
    assert time.monotonic() - began < 60


def test_probabilities_sum(spark):
    field = spark.createDataFrame([(2022, 1, f"d{i:02}", float(i), 0.1) for i in range(1, 21)], "year int, round int, driver string, score double, p_dnf double")
    p = simulation.probabilities(simulation.simulate(field, 50)).agg(F.sum("p_win"), F.sum("p_podium"), F.sum("p_top10")).first()
    assert list(p) == pytest.approx([1, 3, 10])


def test_simulations_are_spread_over_tasks(spark):
    """Not all in one, however small the field is before its simulations are dealt."""
    events = [(2022, r, f"d{i:02}", float(i), 0.1) for r in range(1, 13) for i in range(1, 6)]
    field = spark.createDataFrame(events, "year int, round int, driver string, score double, p_dnf double")
    sizes = [r["count"] for r in simulation.simulate(field, 1000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12 * 5 * 1000 and len(sizes) > 8 and max(sizes) <= sum(sizes) / 4


def test_fit_total_is_the_fixed_point(spark):
    values = [0.9, 0.8, 0.5, 0.2, 0.1, 0.05]
    p = spark.createDataFrame([(2022, 1, f"d{i}", x) for i, x in enumerate(values)], "year int, round int, driver string, p double")
    got = [x for _, x in sorted(pick(simulation.fit_total(p, "p", 3.0), "driver", "p"))]
    want = values
    for _ in range(500):
        want = [min(1.0, x * 3.0 / sum(want)) for x in want]
    assert got == pytest.approx(want, abs=1e-6) and sum(got) == pytest.approx(3.0)


#: Laps of two drivers in three sessions; the best of the second and the third is 0.
ZERO_LAPS = [("2024-01-01", 1, 1, 50.0), ("2024-01-01", 2, 1, 60.0), ("2024-01-02", 1, 1, 0.0), ("2024-01-02", 2, 1, 3.0), ("2024-01-04", 1, 1, 0.0), ("2024-01-04", 2, 1, 0.5)]


def zero_laps(spark):
    x = spark.createDataFrame(ZERO_LAPS, "session string, driver int, lap int, seconds double")
    return x.select(F.col("session").cast("date").alias("session"), "driver", "lap", "seconds", F.lit("view").alias("kind"), F.lit(None).cast("string").alias("deleted"))


def test_best_lap_gap_above_a_best_of_zero(spark):
    got = {(str(r.session), r.driver): str(r.best_gap_pct) for r in sessions.best_lap_gap(zero_laps(spark)).collect()}
    assert got == {("2024-01-01", 1): "0.0", ("2024-01-01", 2): "20.0", ("2024-01-02", 1): "nan", ("2024-01-02", 2): "inf", ("2024-01-04", 1): "nan", ("2024-01-04", 2): "inf"}


def test_quali_gap_above_a_best_of_zero(spark):
    times = zero_laps(spark).select("session", "driver", F.col("seconds").alias("q1"), F.lit(None).cast("double").alias("q2"))
    got = {(str(r.session), r.driver): str(r.quali_gap_pct) for r in sessions.quali_gap(times, "q1", "q2").collect()}
    assert got == {("2024-01-01", 1): "0.0", ("2024-01-01", 2): "20.0", ("2024-01-02", 1): "nan", ("2024-01-02", 2): "inf", ("2024-01-04", 1): "nan", ("2024-01-04", 2): "inf"}


def test_weekend_table_of_sessions_with_a_best_of_zero(spark):
    """NaN is the largest, as in SQL: it is an event's best gap only where there is no other."""
    got = {(r.event, r.driver): (str(r.fp_best_gap), str(r.fp_last_gap), r.fp_n) for r in sessions.weekend_table(zero_laps(spark)).collect()}
    assert got == {(0, 1): ("0.0", "nan", 2), (0, 2): ("20.0", "inf", 2), (1, 1): ("nan", "nan", 1), (1, 2): ("inf", "inf", 1)}


def test_quali_gap_above_a_tiny_best_is_rounded_as_in_sql(spark, tmp_path):
    """Of gaps above a nanosecond's fraction six places are beyond a double's digits; values are compared exactly."""
    value = F.when(F.col("id") % 40 == 1, F.col("id") * 1e-10).otherwise(F.col("id") * 0.37)
    events = spark.range(1, 800).select(F.col("id").alias("event_id"), F.to_timestamp_ntz(F.lit("2024-01-01 10:00:00")).alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), value.alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.driver: (r.best, r.quali_gap_pct) for r in queries.QUERIES["quali_gap"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {d: (b, g) for d, b, g in con.sql(f"SELECT driver, best, quali_gap_pct FROM ({ORACLE_SQL['quali_gap']})").fetchall()}
    assert max(g for _, g in want.values()) > 1e10 and got == want


def test_rounding_is_that_of_sql(spark):
    ties = [i / 2e6 for i in range(1, 20_000)] + [-i / 2e6 for i in range(1, 2_000, 2)] + [1e14 / i for i in range(1, 20_000)]
    odd = [None, float("inf"), float("-inf"), 0.0, 1e305, -1e308, 5e-324]
    x = spark.createDataFrame([(v,) for v in ties + odd], "x double").coalesce(1)
    got = [r.x for r in queries.r6(x).collect()]
    assert got == [v for (v,) in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [ties + odd]).fetchall()]
    assert str(queries.r6(spark.createDataFrame([(float("nan"),)], "x double")).first().x) == "nan"


def test_weekend_table_of_laps_without_a_day(spark, tmp_path):
    """They are a row for each driver, as in the SQL, not left out."""
    day = F.when(F.col("id") % 4 > 0, F.timestamp_add("HOUR", (F.col("id") * 7).cast("int"), F.to_timestamp_ntz(F.lit("2024-01-01 00:30:00"))))
    driver = F.when(F.col("id") % 23 > 0, F.col("id") % 3)
    events = spark.range(1, 60).select(F.col("id").alias("event_id"), day.alias("ts"), driver.alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 1.5).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["weekend_table"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare.rows(got) == compare.rows(con.sql(ORACLE_SQL["weekend_table"]).df())
    assert sorted(got[got.event.isna()].fp_n) == [0, 0, 0] and got[got.event.isna()].fp_last_gap.isna().all()


def test_session_rules(spark):
    schedule = sessions.calendar(spark)
    early = {(r.round, r.name) for r in sessions.earlier_sessions(schedule).collect()}
    assert {n for r, n in early if r == 1} == {"Practice 1", "Practice 2", "Practice 3"}
    assert {n for r, n in early if r == 3} == {"Practice 1", "Sprint Qualifying", "Sprint"}


def test_elo_shrinks_teams_harder_at_a_new_era(spark):
    """a beats b in 1994. 1995 begins an era but its only event doesn't count; 1996 and 1998 do, and 1998 begins one."""
    events = [(1994, 1, True), (1995, 1, False), (1996, 1, True), (1998, 1, True)]
    rows = [(y, r, d, t, p, ok) for y, r, ok in events for d, t, p in (("a", "x", 1), ("b", "y", 2))]
    out = models.elo(spark.createDataFrame(rows, "year int, round int, driver string, team string, position int, race_ok boolean"))
    got = {x.year: (x.elo_driver, x.elo_team) for x in out.filter("driver = 'a'").collect()}
    d, t = 15.0, 25.0  # half of each K: the rivals were level
    late = 1 - 1 / (1 + 10 ** (-2 * 0.75 * (d + t) / 400))
    want = {1994: (0, 0), 1995: (d * 0.75, t * 0.3), 1996: (d * 0.75, t * 0.75), 1998: ((d * 0.75 + 30 * late) * 0.75, (t * 0.75 + 50 * late) * 0.3)}
    assert {y: pytest.approx(w) for y, w in want.items()} == got


def test_a_history_unfit_for_features_is_refused(spark):
    good = [row(2022, 1, d) for d in "ab"]
    assert form.usable_history(frame(spark, [*good, row(2022, 2, "a", race_ok=False)])).count() == 2
    for bad, fault in (([row(2022, 1, "a")], "listed twice"), ([row(2022, 2, "c", race_ok=None)], "without race_ok"), ([row(2022, None, "c")], "without a key")):
        with pytest.raises(ValueError, match=fault):
            form.usable_history(frame(spark, good + bad))


def test_other_grids(spark):
    given = form.grid_features(frame(spark, [row(2022, 1, d, grid=g) for d, g in (("a", 1.0), ("b", 0.0), ("c", 3.0), ("d", 2.0))]))
    slots = spark.createDataFrame([(2022, 1, "a", 2.5), (2022, 1, "b", 1.0), (2022, 1, "d", 0.0)], "year int, round int, driver string, slot double")
    got = {r.driver: (r.grid, r.grid_pit_lane, r.grid_frac) for r in form.with_grids(given, slots, "slot").collect()}
    assert got == {"a": (2.5, 0.0, 0.625), "b": (1.0, 0.0, 0.25), "c": (3.5, 0.0, 0.875), "d": (3.5, 1.0, 0.875)}


def test_starts_in_utc(spark):
    """Zones with offsets and with summer time, and none; sessions finish by UTC."""
    at = "2024-07-05 10:00:00"
    rows = [(1, "+02:00"), (2, "America/New_York"), (3, None)]
    schedule = spark.createDataFrame(rows, "round int, zone string").selectExpr("2024 AS year", "round", "zone", *(f"'Practice {i}' AS session{i}" for i in range(1, 6)), *(f"timestamp'{at}' AS start{i}" for i in range(1, 6)))
    got = {r["round"]: r.start1.hour for r in sessions.in_utc(schedule).collect()}
    assert got == {1: 8, 2: 14, 3: 10}
    done = sessions.finished_sessions(sessions.in_utc(schedule), F.lit("2024-07-05 16:00:00").cast("timestamp"))
    assert {r["round"] for r in done.select("round").distinct().collect()} == {1, 3}
