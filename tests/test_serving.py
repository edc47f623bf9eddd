"""Features of many entry lists at once against one call each, and circuit years against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import circuits, form, serving
from paceline.sources.scratch import written
from tests.test_form import COLUMNS, NAMES, row


def league(spark, seed, years=4, rounds=6, drivers=8):
    """Circuits that are visited more than once a year, events that don't count, entrants that come and go."""
    r = random.Random(seed)
    rows = []
    for y in range(2018, 2018 + years):
        for rnd in range(1, rounds + 1):
            ok = r.random() > 0.15
            for d in r.sample(range(drivers), r.randint(3, drivers)):
                rows.append(row(y, rnd, f"d{d}", float(r.randint(1, 20)) if r.random() > 0.1 else None, f"t{r.randrange(3)}", no=d, circuit=rnd % 3, grid=float(r.randint(0, 9)), dnf=r.random() < 0.2, race_ok=ok, points=float(r.randint(0, 9))))
    return spark.createDataFrame(rows, COLUMNS), [dict(zip(NAMES, x, strict=True)) for x in rows]


@pytest.fixture(scope="module")
def given(spark):
    frame, rows = league(spark, 1)
    return written(frame), rows


def slow_years(rows, year, rnd, circuit, drivers, share=0.25):
    before = [x for x in rows if (x["year"], x["round"]) < (year, rnd) and x["race_ok"] and x["circuit"] == circuit]
    need = math.ceil(len(drivers) * share - 1e-9)
    return {y: n for y in {x["year"] for x in before} if (n := len({x["driver"] for x in before if x["year"] == y} & drivers)) >= max(need, 1)}


@pytest.mark.parametrize("share", [0.25, 0.6, 1.0])
def test_years_of_explicit_grids(spark, given, share):
    frame, rows = given
    r = random.Random(2)
    lists = {}
    for i in range(25):
        lists[i] = r.randint(2017, 2023), r.randint(1, 7), r.randrange(4), {f"d{d}" for d in r.sample(range(10), r.randint(1, 7))}
    targets = spark.createDataFrame([(i, y, n, c, d) for i, (y, n, c, ds) in lists.items() for d in ds], "t int, year int, round int, circuit int, driver string")
    got = {}
    for x in circuits.eligible_years_at(frame, targets, share).collect():
        got.setdefault(x.t, {})[x.past_year] = x.raced
        assert x.entrants == len(lists[x.t][3])
    assert got == {i: w for i, (y, n, c, ds) in lists.items() if (w := slow_years(rows, y, n, c, ds, share))}


def test_rows_grow_with_years_not_with_visits(spark):
    """An entrant who visits a circuit every day meets a row for each year."""
    days = 60
    rows = [row(y, n, "a", 1.0, circuit=0) for y in (2018, 2019, 2020) for n in range(1, days + 1)]
    frame = spark.createDataFrame(rows, COLUMNS)
    seen = circuits.seen_by_entrants(circuits.events_of(frame), frame)
    # of each year's events all meet the years before, and all but the first what came before them in their own
    assert seen.count() == days * (0 + 1 + 2) + 3 * (days - 1)
    top = seen.groupBy("t").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0]
    assert top == len(rows) - 1


def entries(spark, given, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(12):
        y, n = r.choice([(2018, 1), (2019, 3), (2020, 4), (2021, 6), (2022, 1), (2021, 7), (2020, 4)])
        for d in r.sample(range(10), r.randint(1, 8)):
            out.append((f"l{i}", y, n, f"d{d}", f"t{r.randrange(4)}", n % 3, float(r.randint(0, 9)), r.choice([None, r.random()]), r.random(), 99.0))
    return spark.createDataFrame(out, "list string, year int, round int, driver string, team string, circuit int, grid double, fp_best_gap double, fp_last_gap double, position double")


def test_many_lists_equal_one_call_each(spark, given):
    frame, _ = given
    asked = written(entries(spark, given))
    got = {(r.list, r.driver): r.asDict() for r in serving.features_at(frame, asked).collect()}
    assert len(got) == asked.count()
    for (name,) in asked.select("list").distinct().collect():
        own = asked.filter(F.col("list") == name)
        own_rows = own.drop("list", "position").withColumn("race_ok", F.lit(False))
        year, rnd = own.select("year", "round").first()
        both = form.before(frame, year, rnd).unionByName(own_rows, allowMissingColumns=True)
        at = lambda df: df.filter((F.col("year") == year) & (F.col("round") == rnd))  # noqa: B023, E731
        parts = [at(b(both)) for b in (form.driver_form, circuits.circuit_history, form.grid_features, form.weekend_pace)]
        want = {}
        for p in parts:
            for r in p.collect():
                want.setdefault(r.driver, {}).update(r.asDict())
        teams = {r.team: r.asDict() for r in at(form.team_form(both)).collect()}
        for r in own.collect():
            for k, v in (want[r.driver] | teams[r.team]).items():
                if k != "team":
                    assert got[name, r.driver][k] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (name, r.driver, k)


def test_added_entrants_change_nothing_else(spark, given):
    frame, _ = given
    asked = entries(spark, given)
    for build, who in ((form.driver_form, "driver"), (form.team_form, "team")):
        with_more = build(serving.with_entrants(frame, asked, who)).join(frame.select("year", "round", who), ["year", "round", who], "left_semi")
        assert with_more.exceptAll(build(frame)).isEmpty() and build(frame).exceptAll(with_more).isEmpty()


@pytest.mark.parametrize(("change", "fault"), [
    ({"driver": None}, "missing"), ({"team": None}, "missing"), ({"round": 9}, "several"), ({"circuit": 9}, "several"), ({"driver": "b"}, "twice"),
])
def test_entries_are_checked(spark, given, change, fault):
    rows = [dict(list="x", year=2020, round=1, driver=d, team="t", circuit=1) for d in "abc"]
    rows[0] |= change
    with pytest.raises(ValueError, match=fault):
        serving.features_at(given[0], spark.createDataFrame([tuple(r.values()) for r in rows], "list string, year int, round int, driver string, team string, circuit int"))


def test_score_entries_takes_one_event(spark, given):
    two = entries(spark, given).drop("list")
    with pytest.raises(ValueError, match="one event"):
        form.score_entries(given[0], two, form.driver_form)
