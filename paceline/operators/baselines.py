"""Ranking baselines: a score per entrant and event, lower is better. History is keyed by code, as announced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.form import RACE, last, ranked


def over_field(value: Column) -> Column:
    return value.over(Window.partitionBy(*RACE))


def scored(history: DataFrame, score: Column, model: str) -> DataFrame:
    return history.select(F.lit(model).alias("model"), *RACE, "driver", score.alias("score"))


def grid_equals_finish(history: DataFrame) -> DataFrame:
    slot = F.when(F.col("grid") > 0, F.col("grid"))
    return scored(history, F.coalesce(slot, F.coalesce(over_field(F.max(slot)), F.lit(0.0)) + 1), "grid")


def previous(history: DataFrame, value: str = "position", fallback: str = "grid") -> DataFrame:
    """The last known value; newcomers come behind all others, in the order of the fallback."""
    known = F.last(F.when(F.col("race_ok"), F.col(value)), ignorenulls=True)
    known = known.over(Window.partitionBy("code").orderBy(*RACE).rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("previous", known)
    behind = F.coalesce(over_field(F.max("previous")), F.lit(0.0))
    slot = F.coalesce(F.when(F.col(fallback) > 0, F.col(fallback)), F.lit(1.0))
    return scored(h, F.coalesce("previous", behind + slot), "previous")


def mean_last5(history: DataFrame, value: str = "position", fallback: str = "grid") -> DataFrame:
    """The mean of the last five known values, unknown ones not being counted as events."""
    h = ranked(history, "code", F.col(value).isNotNull())
    h = h.withColumn("mean", last(F.col(value), 5, "code"))
    behind = F.coalesce(over_field(F.max("mean")), F.lit(0.0))
    slot = F.coalesce(F.when(F.col(fallback) > 0, F.col(fallback)), F.lit(1.0))
    return scored(h, F.coalesce("mean", behind + slot), "mean_last5")


def practice(history: DataFrame) -> DataFrame:
    best = F.col("fp_best_gap")
    return scored(history, F.coalesce(best, over_field(F.max(best)) + 1, F.lit(0.0)), "practice")


BASELINES = {"grid": grid_equals_finish, "previous": previous, "mean_last5": mean_last5, "practice": practice}


def previous_race(history: DataFrame) -> DataFrame:
    """Qualifying as the last race ended: the last known finishing place; newcomers behind all others, as they are told."""
    return previous(history, "position").withColumn("model", F.lit("previous_race"))


#: The baselines of each target; those of qualifying are known before there is a grid.
BY_TARGET = {
    "finish": BASELINES,
    "quali": {"previous": lambda h: previous(h, "quali"), "previous_race": previous_race, "mean_last5": lambda h: mean_last5(h, "quali"), "practice": practice},
}


def all_scores(history: DataFrame) -> DataFrame:
    out = None
    for build in BASELINES.values():
        part = build(history)
        out = part if out is None else out.unionByName(part)
    return out
