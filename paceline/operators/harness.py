"""Walk-forward evaluation of every model and baseline in one table of scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import baselines, models, walkforward
from paceline.operators.evaluation import race_metrics
from paceline.operators.folds import Folds, dealt, walk_forward
from paceline.operators.form import RACE
from paceline.sources.scratch import written

KEYS = (*RACE, "driver")


def forest(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, trees: int = 200, depth: int = 8, least: int = 15, seed: int = 1) -> DataFrame:
    """year, round, driver, score of random forests, one for each fit; two seasons with the same training rows share it.

    pyspark.ml grows one forest at a time, so this loops over fits, of which there are as many as seasons at most. Rows
    of all folds are scaled, filled and written once.
    """
    scales = {f: s.scale for f, s in walkforward.fold_sums(table, names, y, folds).items()}
    rows = walkforward.with_scale(dealt(table, y, folds), names, scales)
    rows = written(rows.select("fold", "train", *KEYS, F.col(y).cast("double").alias("y"), "v")).withColumn("x", array_to_vector("v"))
    out = None
    for f in folds.fits:
        learner = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="0.5", seed=seed)
        own = rows.filter(F.col("fold") == f)
        fitted = learner.fit(own.filter("train").select("x", "y"))
        part = fitted.transform(own.filter("NOT train")).select(*KEYS, F.col("prediction").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def elo(history: DataFrame, folds: Folds) -> DataFrame:
    """Ratings before an event know nothing later, so they need no fit by season."""
    return models.elo(history).filter(F.col("year").isin(*folds.seasons)).select(*KEYS, F.col("elo_score").alias("score"))


RANKERS = walkforward.RANKERS | {"forest": forest}


def walk_forward_scores(history: DataFrame, rankers: tuple[str, ...] = tuple(RANKERS), names: tuple[str, ...] = models.FEATURES, target: str = "position", seasons: tuple[int, ...] | None = None, locked: tuple[int, ...] = (2001,), allow_locked: bool = False) -> DataFrame:
    """model, year, round, driver, score of every ranker on every test season, fitted on the seasons before it.

    Features are computed once for all events: they know nothing from an event on, so a fold needs no features of its
    own. All entrants are scored, whether their outcome is known or not.
    """
    table = written(models.rows(history, names))
    folds = walk_forward(table, target, seasons, locked, allow_locked)
    if not folds.of:
        raise ValueError("no season has one with results before it")
    out = None
    for name in rankers:
        part = RANKERS[name](table, names, target, folds).select(F.lit(name).alias("model"), *KEYS, "score")
        out = part if out is None else out.unionByName(part)
    return out


def walk_forward_metrics(history: DataFrame, rankers: tuple[str, ...] = tuple(RANKERS), seasons: tuple[int, ...] | None = None, with_elo: bool = True) -> DataFrame:
    """Metrics of each model and baseline on each test event, all on the same events."""
    history = written(history)
    out = walk_forward_scores(history, rankers, seasons=seasons)
    folds = walk_forward(history, "position", seasons)
    if with_elo:
        out = out.unionByName(elo(history, folds).select(F.lit("elo").alias("model"), *KEYS, "score"))
    simple = baselines.all_scores(history).filter(F.col("year").isin(*folds.seasons)).select("model", *KEYS, "score")
    return race_metrics(out.unionByName(simple), history)
