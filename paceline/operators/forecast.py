"""Forecasts as they would have been made: each season's from models fitted on the seasons before it. And the search of
model settings on development seasons."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.operators import models, simulation
from paceline.operators.evaluation import development_only, race_metrics
from paceline.operators.form import RACE, before, kept

#: Settings that are tried, simpler ones first, so that of equals the simpler wins. Fixed values.
GRIDS: dict[str, dict[str, tuple[float, ...]]] = {
    "ridge": {"alpha": (300.0, 100.0, 30.0, 10.0, 3.0)},
    "plackett_luce": {"penalty": (10.0, 3.0, 1.0, 0.3)},
    "elo": {"k_driver": (15.0, 30.0, 60.0), "k_team": (25.0, 50.0, 100.0), "keep": (0.9, 0.75, 0.5)},
}
RISKY = tuple(c for c in models.FEATURES if "dnf" in c or "grid" in c)
LOG = "trial_id int, target string, model string, params string, dev_spearman double, dev_races int, chosen boolean"


def tested_seasons(history: DataFrame, seasons: tuple[int, ...] | None = None, locked: tuple[int, ...] = (2001,), allow_locked: bool = False) -> list[int]:
    """The seasons to forecast, in order: those named, else all, that have a season before them and aren't locked."""
    known = sorted(r.year for r in history.select("year").distinct().collect())  # a handful of seasons
    found = [y for y in known[1:] if seasons is None or y in seasons]
    if seasons is not None and not allow_locked and set(seasons) & set(locked):
        raise ValueError(f"locked seasons: {sorted(set(seasons) & set(locked))}")
    return [y for y in found if allow_locked or y not in locked]


def dnf_chance(rate: Column, risk: Column) -> Column:
    """The field's rate, dealt by each entrant's risk over the event's mean."""
    share = F.coalesce(F.try_divide(risk, F.avg(risk).over(Window.partitionBy(*RACE))), F.lit(1.0))
    return F.greatest(F.lit(0.005), F.least(F.lit(0.995), rate * share))


def season_forecast(table: DataFrame, rate: DataFrame, season: int, grids: DataFrame | None = None) -> DataFrame | None:
    """year, round, driver, grid, score, p_dnf and base_p_*, the chances from the grid slot alone, of one season's
    entrants; None if no earlier season has results.

    table: as models.rows gives it. With grids (year, round, driver, predicted) the entrants are shown predicted
    slots, and the chances by slot are learned from the predicted slots of earlier seasons, if there are any.
    """
    train = models.train_rows(table, "position", season - 1)
    if train.isEmpty():
        return None
    shown = table.filter(F.col("year") == season)
    slots = train
    if grids is not None:
        shown = shown.join(grids, [*RACE, "driver"], "left").withColumn("grid", F.coalesce("predicted", "grid")).drop("predicted")
        predicted = train.join(grids, [*RACE, "driver"]).withColumn("grid", F.col("predicted")).drop("predicted")
        slots = train if predicted.isEmpty() else predicted
    score = models.ridge(train, models.standardised(train, models.FEATURES), "position")
    fates = models.train_rows(table, "dnf", season - 1)
    risk = models.logistic(fates, models.standardised(fates, RISKY), F.col("dnf"), 0.01)
    x = {"log": F.log("grid"), "slot": F.col("grid")}
    known = slots.filter("grid > 0")
    base = [models.logistic(known, x, F.col("position") <= k, 10.0).alias(f"base_p_{e}") for e, k in simulation.EVENTS.items()]
    out = shown.select(*RACE, "driver", "grid", score.alias("score"), risk.alias("risk"), *base).join(rate, list(RACE))
    return out.select(*RACE, "driver", "grid", "score", dnf_chance(F.col("dnf_rate"), F.col("risk")).alias("p_dnf"), *(f"base_p_{e}" for e in simulation.EVENTS), F.col("dnf_rate").alias("base_p_dnf"))


def predicted_slots(history: DataFrame, first: int) -> DataFrame | None:
    grids = models.out_of_fold_grids(history, first)
    return None if grids is None else grids.select(*RACE, "driver", F.col("grid").alias("predicted"))


def collect(history: DataFrame, seasons: tuple[int, ...] | None = None, predicted_grid: bool = False, allow_locked: bool = False) -> DataFrame:
    """Forecasts before any noise with what came of them (position, dnf), for all events with two known results or more.

    The loop is over seasons; each adds a part to one plan, and its fits are sums over the rows before it.
    """
    tested = tested_seasons(history, seasons, allow_locked=allow_locked)
    table, rate = kept(models.rows(history)), simulation.recent_dnf_rate(history)
    first = history.agg(F.min("year")).first()[0]
    grids = predicted_slots(history, first + 1) if predicted_grid and tested else None
    parts = [p for p in (season_forecast(table, rate, y, grids) for y in tested) if p is not None]
    if not parts:
        raise ValueError("no season has one with results before it")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    known = F.count("position").over(Window.partitionBy(*RACE))
    return out.join(history.select(*RACE, "driver", "position", "dnf"), [*RACE, "driver"]).withColumn("known", known).filter("known >= 2").drop("known")


def probabilities(raw: DataFrame, n_sims: int = 20_000, sigma: float = 0.8, gamma: float = 0.5, seed: int = 0) -> DataFrame:
    """raw with p_win, p_podium, p_top10; p_dnf stays the model's own. Draws are hashes of seed and event."""
    simulated = simulation.chances(raw.select(*RACE, "driver", "score", "p_dnf"), n_sims, sigma, gamma, seed).drop("p_dnf")
    return raw.join(simulated, [*RACE, "driver"])


def report(history: DataFrame, seasons: tuple[int, ...] | None = None, n_sims: int = 20_000, sigma: float = 0.8, gamma: float = 0.5) -> DataFrame:
    """simulation.score_report of walk-forward forecasts, with real and with predicted grids (column mode).

    The forecasts meet the chances by slot that each season's fold learned from those before it, and equal chances.
    """
    actual, out = simulation.outcomes(history), None
    for mode, predicted in (("grid", False), ("predicted_grid", True)):
        raw = kept(collect(history, seasons, predicted_grid=predicted))
        keys = (*RACE, "driver")
        slots = raw.select(*keys, *(F.col(f"base_p_{e}").alias(f"p_{e}") for e in simulation.EVENTS), F.col("base_p_dnf").alias("p_dnf"))
        equal = simulation.uniform_probabilities(raw).join(slots.select(*keys, "p_dnf"), list(keys))
        given = {"forecast": probabilities(raw, n_sims, sigma, gamma), "grid_prior": slots, "uniform": equal}
        part = simulation.score_report(given, actual, "forecast").withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def forecast(history: DataFrame, entries: DataFrame, predicted_grid: bool = False, n_sims: int = 20_000, sigma: float = 0.8, gamma: float = 0.5, seed: int = 0) -> DataFrame:
    """year, round, driver, grid, p_win, p_podium, p_top10, p_dnf, expected_place of one event's entrants.

    entries: year, round, driver, team, circuit and what else is known of the event, grid for one. Outcomes in it are
    ignored, and so is all of history from the event on. Models are fitted on the seasons before the event's.
    """
    events = entries.select(*RACE).distinct().limit(2).collect()
    if len(events) != 1:
        raise ValueError("entries must be of one event")
    year, rnd = events[0]
    outcomes = ("position", "points", "dnf", "race_ok", "pace_gap")
    types = dict(history.dtypes)
    shown = entries.drop(*outcomes).withColumns({c: F.lit(False) if c == "race_ok" else F.lit(None).cast(types[c]) for c in outcomes if c in types})
    if predicted_grid:
        shown = shown.drop("quali", "quali_gap", "grid")
    known = before(history, year, rnd).unionByName(shown, allowMissingColumns=True)
    first = known.agg(F.min("year")).first()[0]
    grids = predicted_slots(known, first + 1) if predicted_grid else None
    raw = season_forecast(kept(models.rows(known)), simulation.recent_dnf_rate(known), year, grids)
    if raw is None:
        raise ValueError(f"no season before {year} has results")
    raw = kept(raw.filter(F.col("round") == rnd))
    places = simulation.probabilities(simulation.simulate(raw.select(*RACE, "driver", "score", "p_dnf"), n_sims, sigma, gamma, seed))
    return raw.select(*RACE, "driver", "grid").join(places, [*RACE, "driver"])


def settings(spark: SparkSession, model: str) -> DataFrame:
    """trial_id and the columns of the model's grid: every combination of its values, in their order.

    One row exploded once for each parameter; a trial's number is that of its values, read as digits.
    """
    grid = GRIDS[model]
    trials = spark.range(1).select(F.lit(0).alias("trial_id"))
    for name, values in grid.items():
        numbered = F.posexplode(F.array(*map(F.lit, values))).alias("at", name)
        trials = trials.select("*", numbered).withColumn("trial_id", F.col("trial_id") * len(values) + F.col("at")).drop("at")
    return trials.orderBy("trial_id")


def tried(spark: SparkSession, model: str) -> dict[int, dict[str, float]]:
    """The settings by trial: a row for each."""
    return {r.trial_id: {k: r[k] for k in GRIDS[model]} for r in settings(spark, model).collect()}


def setting_scores(history: DataFrame, model: str, seasons: tuple[int, ...]) -> DataFrame:
    """model (the setting's number), year, round, driver, score of each setting in each season."""
    trials = tried(history.sparkSession, model)
    if model == "elo":  # ratings before an event know nothing later, so they need no fit by season
        parts = [models.elo(history, **s).filter(F.col("year").isin(*seasons)).select(F.lit(i).alias("model"), *RACE, "driver", F.col("elo_score").alias("score")) for i, s in trials.items()]
    else:
        table, parts = kept(models.rows(history)), []
        for year in seasons:
            train = models.train_rows(table, "position", year - 1)
            if train.isEmpty():
                continue
            x = models.standardised(train, models.FEATURES)
            if model == "ridge":
                sums = models.sums_of_products(train, x, "position")
                columns = {i: models.solved(sums, x, **s) for i, s in trials.items()}
            else:
                columns = {i: -models.weighted(x, models.plackett_luce(train, x, "position", **s)) for i, s in trials.items()}
            each = F.array(*(F.struct(F.lit(i).alias("model"), c.alias("score")) for i, c in columns.items()))
            parts.append(table.filter(F.col("year") == year).select(*RACE, "driver", F.inline(each)).select("model", *RACE, "driver", "score"))
    if not parts:
        raise ValueError(f"none of {seasons} has a season with results before it")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tune(history: DataFrame, model: str, seasons: tuple[int, ...]) -> DataFrame:
    """One row a setting, in order: trial_id, target, model, params, dev_spearman, dev_races, chosen.

    The first setting is taken whose mean rank correlation none after it exceeds by more than 1e-12. Only development
    seasons are scored, and all settings in one job; what reaches the driver is a row for each setting.
    """
    shown = history.filter(F.col("year") <= max(seasons))
    metrics = race_metrics(development_only(setting_scores(shown, model, seasons), seasons), shown)
    means = {r.model: r for r in metrics.groupBy("model").agg(F.avg("spearman").alias("mean"), F.count("*").alias("races")).collect()}
    trials, best = [], None
    for i, s in tried(history.sparkSession, model).items():
        if i not in means:
            continue
        if best is None or means[i]["mean"] > means[best]["mean"] + 1e-12:
            best = i
        trials.append((i, "finish", model, json.dumps(s, sort_keys=True), float(means[i]["mean"]), int(means[i].races)))
    return history.sparkSession.createDataFrame([(*t, t[0] == best) for t in trials], LOG)
