"""Walk-forward forecasts and the search of settings, by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import evaluation, forecast, form, models
from paceline.sources.league import league
from paceline.streaming.ingest import ingest_available

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    return form.kept(league(spark, SF).filter("year <= 1998"))


def plain_ridge(table, season, alpha):
    """Scores of a season's entrants from all rows that count before it."""
    names = list(models.FEATURES)
    train = table[(table.year < season) & table.race_ok & table.position.notna()]
    median = train[names].median().fillna(0.0)
    x, y = train[names].fillna(median).to_numpy(), train.position.to_numpy()
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1.0
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(names)), z.T @ y)
    test = table[table.year == season]
    return {(r.year, r.round, r.driver): s for r, s in zip(test.itertuples(), (test[names].fillna(median).to_numpy() - mean) / spread @ w + y.mean(), strict=True)}


def test_each_season_is_forecast_from_those_before_it(history):
    table = models.rows(history).toPandas()
    want = {}
    for season in sorted(table.year.unique())[1:]:
        want |= plain_ridge(table, season, 10.0)
    got = forecast.collect(history).toPandas()
    assert len(got) == len(want) > 0
    assert all(abs(r.score - want[r.year, r.round, r.driver]) < 1e-8 for r in got.itertuples())
    assert got.p_dnf.between(0.005, 0.995).all() and got.base_p_win.between(0, 1).all()


def test_later_seasons_change_no_forecast(history):
    key = ["year", "round", "driver"]
    whole = forecast.collect(history, (1997,)).toPandas().sort_values(key)
    alone = forecast.collect(history.filter("year <= 1997"), (1997,)).toPandas().sort_values(key)
    assert len(whole) == len(alone) > 0
    for c in ("score", "p_dnf", "base_p_podium", "base_p_dnf"):
        assert np.allclose(whole[c], alone[c])


def test_locked_seasons_are_refused(spark, history):
    late = history.limit(5).withColumn("year", F.lit(2001)).unionByName(history)
    with pytest.raises(ValueError, match="locked"):
        forecast.tested_seasons(late, (2001,))
    assert 2001 not in forecast.tested_seasons(late) and 2001 in forecast.tested_seasons(late, allow_locked=True)
    with pytest.raises(ValueError, match="before"):
        forecast.collect(history.filter("year = 1995"))


def test_the_forecast_of_an_event_knows_nothing_of_it(history):
    entries = history.filter("year = 1998 AND round = 5")
    other = entries.withColumns({"position": F.lit(21.0) - F.col("position"), "dnf": ~F.col("dnf"), "points": F.lit(99.0)})
    known = history.filter("NOT (year = 1998 AND round = 5)")
    one, two = (forecast.forecast(known.unionByName(e), e, n_sims=300).toPandas().sort_values("driver") for e in (entries, other))
    assert len(one) == entries.count() and one.equals(two)
    assert abs(one.p_win.sum() - 1) < 1e-9 and abs(one.p_podium.sum() - 3) < 1e-9
    n = len(one)
    assert abs(one.expected_place.sum() - n * (n + 1) / 2) < 1e-6
    hidden = forecast.forecast(known, entries.drop("grid", "quali", "quali_gap"), predicted_grid=True, n_sims=50).toPandas()
    seen = forecast.forecast(known.unionByName(entries), entries, predicted_grid=True, n_sims=50).toPandas()
    assert sorted(hidden.grid) == sorted(seen.grid) and abs(hidden.grid.sum() - n * (n + 1) / 2) < 1e-6
    with pytest.raises(ValueError, match="one event"):
        forecast.forecast(history, history, n_sims=5)


def test_probabilities_keep_the_models_chance_to_retire(history):
    raw = form.kept(forecast.collect(history, (1998,)).filter("round = 3"))
    out = forecast.probabilities(raw, 200).toPandas().set_index("driver")
    assert out.p_dnf.to_dict() == raw.toPandas().set_index("driver").p_dnf.to_dict() and abs(out.p_top10.sum() - 10) < 1e-9


def test_tuning_takes_the_first_of_the_best(spark, history):
    table = models.rows(history).toPandas()
    seasons, means = (1997, 1998), []
    actual = {(r.year, r.round, r.driver): r.position for r in table.itertuples() if r.position == r.position}
    for s in forecast.tried(spark, "ridge").values():
        scored = {k: v for y in seasons for k, v in plain_ridge(table, y, s["alpha"]).items() if k in actual}
        each = []
        for event in {k[:2] for k in scored}:
            a, b = (np.argsort(np.argsort(x)) for x in zip(*((scored[k], actual[k]) for k in scored if k[:2] == event), strict=True))
            each.append(np.corrcoef(a, b)[0, 1])
        means.append(np.mean(each))
    got = forecast.tune(history, "ridge", seasons).orderBy("trial_id").collect()
    assert np.allclose([r.dev_spearman for r in got], means)
    assert [r.trial_id for r in got if r.chosen] == [int(np.argmax(means))] and {r.dev_races for r in got} == {len(each)}
    same = forecast.setting_scores(history, "elo", seasons).filter("model < 2")
    assert same.select("model").distinct().count() == 2
    with pytest.raises(evaluation.TuningLeakError):
        evaluation.development_only(same, (1998,))


def test_every_batch_of_an_ingest_is_counted(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(0, 120, 1, 120).write.parquet(source)
    assert ingest_available(spark, source, "id bigint", target, state, files_per_batch=1) == spark.read.parquet(target).count() == 120
    assert spark.conf.get("spark.sql.streaming.numRecentProgressUpdates") == "100"


def test_report_scores_forecasts_in_both_modes(history):
    got = {(r.mode, r.event, r.model): r for r in forecast.report(history, (1998,), 300).collect()}
    assert len(got) == 2 * 4 * 3
    raw = forecast.collect(history, (1998,), predicted_grid=True).toPandas()
    p = raw.base_p_podium.clip(1e-3, 1 - 1e-3)
    known = raw[raw.position.notna()].index
    loss = -np.where(raw.position <= 3, np.log(p), np.log(1 - p))
    mean = np.mean([loss[known.intersection(x.index)].mean() for _, x in raw.groupby(["year", "round"])])
    row = got["predicted_grid", "podium", "grid_prior"]
    assert row.logloss == pytest.approx(mean, abs=1e-9) and row.best_baseline is None
    assert all(got[m, e, "forecast"].best_baseline in ("grid_prior", "uniform") for m in ("grid", "predicted_grid") for e in ("win", "podium", "top10", "dnf"))
