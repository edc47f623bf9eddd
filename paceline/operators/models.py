"""Models that score entrants: fitted in Spark, lower scores are better.

Linear algebra of the size of the features is solved on the driver from sums that Spark aggregates; trees and
logistic regressions are pyspark.ml's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.form import ERAS, RACE, average_rank, driver_form, grid_features, kept, team_form

FEATURES = ("drv_finish_l5", "drv_quali_l5", "drv_qgap_l5", "drv_pace_l5", "drv_dnf_l10", "team_finish_l5", "grid")
WITHOUT_GRID = FEATURES[:-1]
LAST_TRAINED = 1999


def rows(history: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Keys, features, race_ok and the outcomes."""
    f = history.select(*RACE, "driver", "team", "race_ok", "position", F.col("quali").alias("y_quali"), "dnf")
    f = f.join(driver_form(history), [*RACE, "driver"]).join(team_form(history), [*RACE, "team"]).join(grid_features(history), [*RACE, "driver"])
    return f.select(*RACE, "driver", "race_ok", "position", "y_quali", "dnf", *names)


def train_rows(table: DataFrame, y: str, until: int = LAST_TRAINED) -> DataFrame:
    return table.filter(F.col("race_ok") & (F.col("year") <= until) & F.col(y).isNotNull())


def standardised(train: DataFrame, names: tuple[str, ...]) -> dict[str, Column]:
    """Columns filled with the training median (0 if never known) and scaled by the population's deviation."""
    medians = train.agg(*(F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(c) for c in names)).first()
    filled = {c: F.coalesce(F.col(c), F.lit(float(medians[c]))) for c in names}
    moments = train.agg(*(F.avg(v).alias(f"m_{c}") for c, v in filled.items()), *(F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items())).first()
    return {c: (v - F.lit(moments[f"m_{c}"] or 0.0)) / F.lit(moments[f"s_{c}"] or 1.0) for c, v in filled.items()}


Sums = tuple[np.ndarray, np.ndarray, float]


def sums_of_products(train: DataFrame, x: dict[str, Column], y: str) -> Sums:
    """Products of the features with each other and with y, and the mean of y: one aggregation."""
    t = train.select(*(v.alias(f"x{i}") for i, v in enumerate(x.values())), F.col(y).cast("double").alias("y"))
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    s = t.agg(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"q{i}") for i in range(n)), F.avg("y").alias("mean")).first()
    a, b = np.zeros((n, n)), np.array([s[f"q{i}"] or 0.0 for i in range(n)])
    for i, j in pairs:
        a[i, j] = a[j, i] = s[f"p{i}_{j}"] or 0.0
    return a, b, float(s["mean"] or 0.0)


def weighted(x: dict[str, Column], w: np.ndarray, start: float = 0.0) -> Column:
    out = F.lit(start)
    for v, c in zip(x.values(), w, strict=True):
        out = out + v * float(c)
    return out


def solved(sums: Sums, x: dict[str, Column], alpha: float) -> Column:
    a, b, mean = sums
    return weighted(x, np.linalg.solve(a + alpha * np.eye(len(b)), b), mean)  # the columns have mean 0, so the intercept is the mean


def ridge(train: DataFrame, x: dict[str, Column], y: str, alpha: float = 10.0) -> Column:
    """Least squares with a penalty on all but the intercept."""
    return solved(sums_of_products(train, x, y), x, alpha)


def scores(table: DataFrame, score: Column, model: str) -> DataFrame:
    return table.filter(F.col("year") > LAST_TRAINED).select(F.lit(model).alias("model"), *RACE, "driver", score.alias("score"))


def ridge_scores(history: DataFrame) -> DataFrame:
    table = rows(history)
    train = train_rows(table, "position")
    return scores(table, ridge(train, standardised(train, FEATURES), "position"), "ridge")


def _trees(history: DataFrame, learner, model: str) -> DataFrame:
    table = rows(history)
    train = train_rows(table, "position")
    vector = array_to_vector(F.array(*standardised(train, FEATURES).values())).alias("x")
    fitted = learner.fit(train.select(vector, F.col("position").alias("y")))
    test = table.filter(F.col("year") > LAST_TRAINED).select(*RACE, "driver", vector)
    return fitted.transform(test).select(F.lit(model).alias("model"), *RACE, "driver", F.col("prediction").alias("score"))


def forest_scores(history: DataFrame) -> DataFrame:
    return _trees(history, RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=30, maxDepth=6, minInstancesPerNode=15, featureSubsetStrategy="0.5", seed=1), "forest")


def boosted_scores(history: DataFrame) -> DataFrame:
    return _trees(history, GBTRegressor(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.1, minInstancesPerNode=15, seed=1), "boosted")


def logistic(train: DataFrame, x: dict[str, Column], hit: Column, c: float) -> Column:
    """Regularised logistic regression; the chance as a column. One class only: its share."""
    vector = array_to_vector(F.array(*x.values())).alias("x")
    t = train.select(vector, hit.cast("double").alias("y"))
    n, share = t.agg(F.count("*"), F.avg("y")).first()
    if not n or share in (0.0, 1.0):
        return F.lit(float(share or 0.0))
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (c * n), standardization=False).fit(t)
    z = F.lit(float(m.intercept))
    for v, w in zip(x.values(), m.coefficients, strict=True):
        z = z + v * float(w)
    return 1 / (1 + F.exp(-z))


def dnf_risk(history: DataFrame) -> DataFrame:
    """The recent rate of retirements times each entrant's risk over the field's mean risk, within bounds."""
    from pyspark.sql import Window

    from paceline.operators.simulation import recent_dnf_rate

    table = rows(history)
    names = tuple(c for c in FEATURES if "dnf" in c or "grid" in c)
    train = train_rows(table, "dnf")
    risk = logistic(train, standardised(train, names), F.col("dnf"), 0.01)
    test = table.filter(F.col("year") > LAST_TRAINED).select(*RACE, "driver", risk.alias("risk")).join(recent_dnf_rate(history), list(RACE))
    p = F.col("dnf_rate") * F.try_divide(F.col("risk"), F.avg("risk").over(Window.partitionBy(*RACE)))
    return test.select(*RACE, "driver", F.greatest(F.lit(0.005), F.least(F.lit(0.995), p)).alias("p_dnf"))


def grid_prior(history: DataFrame) -> DataFrame:
    """Chances of each outcome from the grid slot alone."""
    from paceline.operators.simulation import EVENTS

    table = rows(history)
    train = train_rows(table, "position")
    x = {"log": F.log("grid"), "slot": F.col("grid")}
    test = table.filter(F.col("year") > LAST_TRAINED)
    return test.select(*RACE, "driver", *(logistic(train, x, F.col("position") <= k, 10.0).alias(f"p_{e}") for e, k in EVENTS.items()))


def pairwise_scores(history: DataFrame) -> DataFrame:
    """A ranker: logistic regression without intercept on feature differences of pairs within an event.

    Pairs are within one event's field, whose size is that of a starting grid.
    """
    table = rows(history)
    train = train_rows(table, "position")
    x = standardised(train, FEATURES)
    t = train.select(*RACE, "driver", "position", F.array(*x.values()).alias("v"))
    other = t.select(*RACE, F.col("driver").alias("d2"), F.col("position").alias("p2"), F.col("v").alias("v2"))
    pairs = t.join(other, list(RACE)).filter(F.col("driver") < F.col("d2"))
    pairs = pairs.select(array_to_vector(F.zip_with("v", "v2", lambda a, b: a - b)).alias("x"), (F.col("position") > F.col("p2")).cast("double").alias("y"))
    m = LogisticRegression(featuresCol="x", labelCol="y", fitIntercept=False, regParam=0.01, standardization=False).fit(pairs)
    z = F.lit(0.0)
    for v, w in zip(x.values(), m.coefficients, strict=True):
        z = z + v * float(w)
    return scores(table, z, "pairwise")


ELO = "year int, round int, driver string, elo_driver double, elo_team double, elo_score double"


def elo(history: DataFrame, k_driver: float = 30.0, k_team: float = 50.0, scale: float = 400.0, keep: float = 0.75, keep_team_at_era: float = 0.3, eras: tuple[int, ...] = ERAS, by: str = "championship") -> DataFrame:
    """Driver and team ratings before every event.

    Ratings shrink when a season begins, those of teams harder when it begins a regulation era. Seasons are counted by
    events that count: between two of these, ratings shrink once, by the later one's factor.

    A rating depends on all that went before in its championship, so each championship's events are replayed in order,
    once, in a group of its own: as many rows as its entrants' starts. Without a column of that name there is one.
    """

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        driver: dict[str, float] = {}
        team: dict[str, float] = {}
        season, out = None, []
        for (year, rnd), race in part.sort_values(["year", "round", "driver"]).groupby(["year", "round"], sort=True):
            before = driver, team
            if season is not None and year != season:
                driver = {k: v * keep for k, v in driver.items()}
                team = {k: v * (keep_team_at_era if year in eras else keep) for k, v in team.items()}
            d = np.array([driver.get(x, 0.0) for x in race["driver"]])
            t = np.array([team.get(x, 0.0) for x in race["team"]])
            total = d + t
            out.append(pd.DataFrame({"year": year, "round": rnd, "driver": race["driver"].to_numpy(), "elo_driver": d, "elo_team": t, "elo_score": -total}))
            known = race["position"].notna().to_numpy()
            if not race["race_ok"].iloc[0] or not known.any():
                driver, team = before
                continue
            season = year
            if known.sum() < 2:
                continue
            p, r = race["position"].to_numpy(float)[known], total[known]
            won = (p[:, None] < p[None, :]) + 0.5 * (p[:, None] == p[None, :])
            gain = (won - 1 / (1 + 10 ** ((r[None, :] - r[:, None]) / scale)))
            np.fill_diagonal(gain, 0.0)
            change = gain.sum(axis=1) / (len(p) - 1)
            names, teams = race["driver"].to_numpy()[known], race["team"].to_numpy()[known]
            for x, c in zip(names, change, strict=True):
                driver[x] = driver.get(x, 0.0) + k_driver * c
            for x in np.unique(teams):
                team[x] = team.get(x, 0.0) + k_team * change[teams == x].mean()
        return pd.concat(out)

    if by not in history.columns:
        return history.select(*RACE, "driver", "team", "position", "race_ok", F.lit(1).alias("one")).groupBy("one").applyInPandas(replay, ELO)
    kind = history.schema[by].dataType.simpleString()
    of_one = lambda key, part: replay(part).assign(**{by: key[0]})
    return history.select(*RACE, "driver", "team", "position", "race_ok", by).groupBy(by).applyInPandas(of_one, f"{ELO}, {by} {kind}")


def plackett_luce(train: DataFrame, x: dict[str, Column], y: str, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights that make the observed orders likeliest, by Newton's method; each step is one aggregation over windows."""
    from paceline.operators import walkforward
    from paceline.sources.scratch import discard, written

    n = len(x)
    rows = written(train.select(F.lit(0).alias("fold"), *RACE, "driver", F.col(y).cast("double").alias("y"), F.array(*x.values()).alias("v")))
    found = lambda w: walkforward.collected(walkforward.plackett_luce_sums(rows, w, n), n)
    weights, _ = walkforward.newton(found, (0,), n, {0: np.full(n, penalty)}, steps)
    discard(rows)
    return weights[0]


def plackett_luce_scores(history: DataFrame) -> DataFrame:
    table = rows(history)
    train = train_rows(table, "position")
    x = standardised(train, FEATURES)
    z = F.lit(0.0)
    for v, w in zip(x.values(), plackett_luce(train, x, "position"), strict=True):
        z = z - v * float(w)
    return scores(table, z, "plackett_luce")


def out_of_fold_grids(history: DataFrame, first: int = 1997) -> DataFrame | None:
    """Predicted starting slots: each season's from a model of qualifying fitted on the seasons before it; None if no
    season has one before it."""
    table = kept(rows(history, WITHOUT_GRID))
    seasons = [r.year for r in table.filter(F.col("year") >= first).select("year").distinct().orderBy("year").collect()]
    if not table.filter(F.col("race_ok") & (F.col("year") < max(seasons, default=first))).limit(1).count():
        return None
    out = None
    for year in seasons:
        train = train_rows(table, "y_quali", year - 1)
        score = ridge(train, standardised(train, WITHOUT_GRID), "y_quali")
        part = table.filter(F.col("year") == year).select(*RACE, "driver", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.select(*RACE, "driver", average_rank(F.col("score"), *RACE).alias("grid"))


def predicted_grid_scores(history: DataFrame) -> DataFrame:
    """The finish from features whose grid is the predicted one, in training as in use.

    With one season there is none before it to predict grids from: then the real ones stand in, and fell_back says so.
    """
    table = rows(history)
    grids = out_of_fold_grids(history)
    fell_back = grids is None
    if not fell_back:
        predicted = grids.select(*RACE, "driver", F.col("grid").alias("predicted"))
        table = table.join(predicted, [*RACE, "driver"], "left").filter(F.col("predicted").isNotNull()).withColumn("grid", F.col("predicted")).drop("predicted")
    train = train_rows(table, "position")
    return scores(table, ridge(train, standardised(train, FEATURES), "position"), "predicted_grid").withColumn("fell_back", F.lit(fell_back))


#: Models by target. Each takes the history and returns model, year, round, driver, score.
MODELS = {
    "finish": {"ridge": ridge_scores, "forest": forest_scores, "boosted": boosted_scores, "plackett_luce": plackett_luce_scores, "pairwise": pairwise_scores, "predicted_grid": predicted_grid_scores, "elo": lambda h: elo(h).filter(F.col("year") > LAST_TRAINED).select(F.lit("elo").alias("model"), *RACE, "driver", F.col("elo_score").alias("score"))},
    "dnf": {"logistic": dnf_risk},
}


def evaluated(history: DataFrame, names: tuple[str, ...], target: str = "finish", locked: tuple[int, ...] = (2001,), allow_locked: bool = False) -> DataFrame:
    """Metrics of each named model on each test event: all entrants are shown to it, known outcomes are scored."""
    from paceline.operators.evaluation import race_metrics

    shown = history if allow_locked else history.filter(~F.col("year").isin(*locked))
    out = None
    for name in names:
        part = MODELS[target][name](shown).select("model", *RACE, "driver", "score")
        out = part if out is None else out.unionByName(part)
    return race_metrics(out, shown)
