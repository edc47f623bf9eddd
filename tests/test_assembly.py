"""The audit, the fact table, guards, models and simulation by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import assembly, audit, evaluation, form, models, simulation
from paceline.plans import queries
from paceline.sources.league import league

SF = "/root/testdata/sf0.001"
RESULTS = "year int, round int, session string, code string, position double"
LAPS = "year int, round int, session string, code string, lap int, seconds double"
MARKERS = "year int, round int, session string, weather_rows long, missing array<string>, unreadable boolean"


def audited(spark, session="Race", places=None, laps=None, weather=5, unreadable=False):
    places = range(1, 21) if places is None else places
    laps = [(i, 2, 90.0) for i in range(len(places))] if laps is None else laps
    results = spark.createDataFrame([(2020, 1, session, f"c{i}", None if p is None else float(p)) for i, p in enumerate(places)], RESULTS)
    driven = spark.createDataFrame([(2020, 1, session, f"c{c}", n, s) for c, n, s in laps], LAPS)
    marker = spark.createDataFrame([(2020, 1, session, weather, [], unreadable)], MARKERS)
    return audit.audit(marker, results, driven).first()


def test_audit_flags(spark):
    assert audited(spark).flags == ""
    assert audited(spark, places=range(1, 12)).flags == "unusual_result_rows"
    assert audited(spark, places=[1, 1, *range(3, 21)]).flags == "no_single_winner"
    assert audited(spark, places=[*range(1, 15), *[None] * 6]).flags == "many_null_positions"
    assert audited(spark, laps=[]).flags == "no_laps" and audited(spark, weather=0).flags == "no_weather"
    assert audited(spark, laps=[(i, 1, 90.0) for i in range(20)]).flags == "many_null_laptimes"
    some = [(i % 20, 2 + i // 20, None if i < 6 else 90.0) for i in range(60)]
    assert audited(spark, laps=some).flags == "some_untimed_laps" and audited(spark, laps=some).laps_ok
    assert audited(spark, session="Qualifying", laps=some).flags == ""
    assert audited(spark, laps=[(i, 2, 90.0) for i in range(17)]).flags == "laps_missing_drivers"
    broken = audited(spark, unreadable=True)
    assert broken.flags == "unreadable_marker,no_weather" and not broken.results_ok and not broken.laps_ok


def test_repeated_entrants_are_flagged(spark):
    results = spark.createDataFrame([(2020, 1, "Race", f"c{min(i, 18)}", float(i + 1)) for i in range(20)], RESULTS)
    got = audit.audit(spark.createDataFrame([(2020, 1, "Race", 1, [], False)], MARKERS), results, spark.createDataFrame([], LAPS)).first()
    assert got.results_dup_drivers == 1 and got.flags == "duplicate_drivers,no_laps"


def test_races_outside_the_calendar_are_refused(spark, monkeypatch):
    whole = queries.championship.schedule
    monkeypatch.setattr(queries.championship, "schedule", lambda s, d: whole(s, d).filter("round <> 3"))
    with pytest.raises(Exception, match="no event of the calendar"):
        queries.built(spark, SF).select("circuit").collect()


def test_history_is_ordered_by_what_is_known_before(spark):
    keys = [tuple(r) for r in queries.QUERIES["build_history"](spark, SF).select("year", "round", "driver").collect()]
    assert keys == sorted(keys)


def test_guards(spark):
    with pytest.raises(evaluation.LockedSeasonError):
        evaluation.check_not_locked((2000, 2001), (2001,))
    evaluation.check_not_locked((2001,), (2001,), allow=True)
    years = spark.createDataFrame([(1997,), (1999,)], "year int")
    with pytest.raises(evaluation.TuningLeakError, match="1999"):
        evaluation.development_only(years, (1997, 1998))
    per_race = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1)], "model string, year int, round int")
    with pytest.raises(ValueError, match="b"):
        evaluation.checked(per_race)


def test_unknown_scores_are_refused(spark):
    field = spark.createDataFrame([(1, 1, "a", float("nan"), 0.1)], "year int, round int, driver string, score double, p_dnf double")
    with pytest.raises(Exception, match="score is unknown"):
        simulation.simulate(field, 3).collect()


def test_chances_against_brute_force(spark):
    """The same noise, sorted by hand."""
    field = spark.createDataFrame([(2000, r, f"d{i}", float(i + 1), 0.05 * i) for r in (1, 2) for i in range(6)], "year int, round int, driver string, score double, p_dnf double")
    noise = simulation._noise(field, 600, 0, simulation.hashed_uniform).collect()
    wins, n = {}, 600
    for r in (1, 2):
        for s in range(1, n + 1):
            rows = [x for x in noise if x.round == r and x.sim == s]
            keys = {x.driver: 1e6 + x.v if x.u < x.p_dnf else x.score + 0.8 * max(x.score, 1) ** 0.5 * x.z for x in rows}
            first = min(keys, key=keys.get)
            wins[r, first] = wins.get((r, first), 0) + 1
    got = simulation.probabilities(simulation.simulate(field, n)).collect()
    assert {(x.round, x.driver): round(x.p_win * n) for x in got if x.p_win} == wins
    mean = np.mean([x.z for x in noise]), np.std([x.z for x in noise])
    assert mean == (pytest.approx(0, abs=0.05), pytest.approx(1, abs=0.05))


def test_noise_search_against_single_settings(spark):
    field = spark.createDataFrame([(2000, r, f"d{i}", float(i + 1), 0.1) for r in (1, 2) for i in range(12)], "year int, round int, driver string, score double, p_dnf double")
    actual = simulation.outcomes(field.select("year", "round", "driver", F.col("score").alias("position"), F.lit(False).alias("dnf")))
    got = {(x.gamma, x.sigma): x.logloss for x in simulation.noise_search(field, actual, (0.0, 0.5), (0.4, 1.0), 100, 7).collect()}
    for (gamma, sigma), loss in got.items():
        p = simulation.probabilities(simulation.simulate(field, 100, sigma, gamma, 7))
        want = simulation.losses(p, actual).agg(F.avg(sum(F.col(f"logloss_{e}") for e in simulation.EVENTS))).first()[0]
        assert loss == pytest.approx(want)
    assert len(got) == 4


def training(spark):
    table = models.rows(league(spark, SF))
    train = models.train_rows(table, "position")
    x = models.standardised(train, models.FEATURES)
    held = train.select("year", "round", "driver", "position", *(v.alias(f"x{i}") for i, v in enumerate(x.values()))).toPandas()
    return table, train, x, held, held[[f"x{i}" for i in range(len(x))]].to_numpy()


def test_ridge_against_numpy(spark):
    table, train, x, held, m = training(spark)
    y = held.position.to_numpy()
    w = np.linalg.solve(m.T @ m + 10 * np.eye(m.shape[1]), m.T @ (y - y.mean()))
    got = train.select("year", "round", "driver", models.ridge(train, x, "position").alias("s")).toPandas()
    both = held.assign(want=y.mean() + m @ w).merge(got, on=["year", "round", "driver"])
    assert np.allclose(both.want, both.s) and np.allclose(m.mean(axis=0), 0, atol=1e-9)


def test_plackett_luce_is_stationary(spark):
    """At the weights found, the gradient of the penalised likelihood is 0."""
    _, train, x, held, m = training(spark)
    w = models.plackett_luce(train, x, "position")
    grad = -w
    for _, race in held.groupby(["year", "round"]):
        v = m[race.sort_values("position").index]
        for k in range(len(v) - 1):
            s = np.exp(v[k:] @ w - (v[k:] @ w).max())
            grad = grad + v[k] - s @ v[k:] / s.sum()
    assert np.abs(grad).max() < 1e-5


def test_pairwise_and_logistic_are_stationary(spark):
    _, train, x, held, m = training(spark)
    hit = (held.position <= 3).to_numpy(float)
    p = train.select("year", "round", "driver", models.logistic(train, x, F.col("position") <= 3, 10.0).alias("p")).toPandas()
    both = held.merge(p, on=["year", "round", "driver"])
    assert both.p.to_numpy().sum() == pytest.approx(hit.sum(), rel=1e-3)  # an intercept without penalty


def test_predicted_grids_are_of_earlier_seasons(spark):
    """Changing a season's qualifying leaves the grids predicted for it as they were."""
    h = form.kept(league(spark, SF))
    other = h.withColumn("quali", F.when(F.col("year") == 1999, 26 - F.col("quali")).otherwise(F.col("quali")))
    pick = lambda t: sorted(map(tuple, models.out_of_fold_grids(t).filter("year = 1999 AND round = 1").collect()))
    assert pick(h) == pick(other)
    assert models.out_of_fold_grids(h.filter("year = 2000")) is None
    assert models.predicted_grid_scores(h.filter("year = 2000")).select("fell_back").distinct().collect()[0][0] is True


def test_championships_are_rated_apart(spark):
    rows = [(y, r, d, t, p, True, c) for c in ("a", "b") for y, r in ((2000, 1), (2000, 2)) for d, t, p in (("x", "m", 1), ("y", "n", 2))]
    frame = spark.createDataFrame(rows, "year int, round int, driver string, team string, position int, race_ok boolean, championship string")
    both = models.elo(frame).filter("championship = 'a'").drop("championship").collect()
    alone = models.elo(frame.filter("championship = 'a'").drop("championship")).collect()
    assert sorted(both) == sorted(alone)


@pytest.mark.parametrize("name", ["forest_scores", "gbt_scores", "pairwise_ranker", "predicted_grid_chain", "grid_prior", "dnf_risk"])
def test_models_beat_chance(spark, name):
    got = queries.QUERIES[name](spark, SF)
    actual = league(spark, SF).select("year", "round", "driver", "position", "dnf")
    both = got.join(actual, ["year", "round", "driver"]).filter("position IS NOT NULL").toPandas()
    assert len(both) > 100
    if "score" in both:
        assert both.score.notna().all()
        assert name == "predicted_grid_chain" or both.score.rank().corr(both.position.rank()) > 0.05
    elif "p_dnf" in both:
        assert both.p_dnf.between(0.005, 0.995).all()
    else:
        assert both.p_win.corr(-both.position) > 0 and (both.p_win <= both.p_top10 + 1e-9).mean() > 0.9
