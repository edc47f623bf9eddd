"""Features for entry lists as of any events: any number of lists, for events past or to come, in one plan.

A feature of an entrant as of an event is what a row of the entrant at that event would have. So entrants that the history
doesn't list there are added to it as rows that count for nothing, which changes no feature of others; rows from the
event on never enter, and nothing is cut off or computed once more for a list. What follows from a list itself, its
grid, its practice and which years count at a circuit for its field, is computed within lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import circuits, form
from paceline.operators.form import RACE

#: What isn't known of an event before it.
OUTCOMES = ("position", "points", "dnf", "race_ok", "pace_gap")


def checked(entries: DataFrame) -> DataFrame:
    """entries, refused unless each list is of one event, names an entrant once and lacks no key. One aggregation."""
    keys = ("list", *RACE, "driver", "team", "circuit")
    nulls = F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in keys)) == 1)
    per = entries.groupBy("list").agg(F.count("*").alias("n"), F.countDistinct("driver").alias("drivers"), F.countDistinct(*RACE).alias("events"), F.countDistinct("circuit").alias("circuits"), nulls.alias("nulls"))
    faults = per.agg(F.count_if(F.expr("nulls > 0")).alias("a key is missing"), F.count_if(F.expr("nulls = 0 AND n > drivers")).alias("an entrant is listed twice"), F.count_if(F.expr("nulls = 0 AND (events > 1 OR circuits > 1)")).alias("a list is of several events")).first()
    if found := [f"{k} in {v} lists" for k, v in faults.asDict().items() if v]:
        raise ValueError("; ".join(found))
    return entries


def with_entrants(history: DataFrame, entries: DataFrame, who: str) -> DataFrame:
    """history and, for each event at which the entries name a driver or team that it doesn't list there, a row of that one
    that counts for nothing: race_ok is null, which no sum and no flag of an event takes into account."""
    new = entries.select(*RACE, who).distinct().join(history.select(*RACE, who), [*RACE, who], "left_anti")
    return history.unionByName(new, allowMissingColumns=True)


def features_at(history: DataFrame, entries: DataFrame, min_share: float = 0.25) -> DataFrame:
    """list, year, round, driver and form, circuit, context, and of what the entries have, grid and practice features.

    entries: list, year, round, driver, team, circuit, and if known grid, fp_best_gap, fp_last_gap. Columns of outcomes in
    it are ignored.
    """
    entries = checked(entries).drop(*OUTCOMES)
    keys = entries.select("list", *RACE, "driver", "team")
    of_drivers = with_entrants(history, entries, "driver")
    out = keys.join(form.driver_form(of_drivers), [*RACE, "driver"]).join(form.team_form(with_entrants(history, entries, "team")), [*RACE, "team"])
    targets = entries.select(F.col("list").alias("t"), *RACE, "circuit", "driver")
    there = circuits.circuit_history_at(history, targets, circuits.priors(of_drivers), min_share).withColumnRenamed("t", "list")
    out = out.join(there.drop(*RACE), ["list", "driver"]).join(form.context(entries), list(RACE))
    if "grid" in entries.columns:
        out = out.join(form.grid_features(entries, ("list",)), ["list", "driver"])
    if {"fp_best_gap", "fp_last_gap"} <= set(entries.columns):
        out = out.join(form.weekend_pace(entries, ("list",)), ["list", "driver"])
    return out.select("list", *RACE, "driver", *(c for c in out.columns if c not in ("list", *RACE, "driver", "team")))
