"""Circuit history: what happened at an event's circuit in the years that count for its entrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.form import RACE, calendar, last, ranked


def threshold(size: Column, min_share: float) -> Column:
    """How many of `size` entrants must have raced somewhere for a year to count."""
    return F.ceil(size * min_share - 1e-9)


def latest_grid(history: DataFrame) -> DataFrame:
    """The entrants of the last event."""
    final = history.agg(F.max(F.struct(*RACE)).alias("final"))
    return history.join(final, F.struct(*RACE) == F.col("final"), "left_semi").select("driver").distinct()


def earlier_by_year(targets: DataFrame, history: DataFrame, by: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """t, the columns of `by`, past_year, and the sums over counting rows of history before (year, round) of each target.

    targets: t, year, round and the columns of `by`. A target meets one row for each earlier year of its key, not one for
    each earlier visit, and what came before it in its own year is a running sum: rows grow with the targets and the
    years. Years without a counting row are left out.
    """
    own = history.filter("race_ok").groupBy(*by, *RACE).agg(F.count("*").alias("rows"), *(v.alias(k) for k, v in sums.items()))
    names = ("rows", *sums)
    yearly = own.groupBy(*by, F.col("year").alias("past_year")).agg(*(F.sum(n).alias(n) for n in names))
    before = targets.select("t", "year", *by).join(yearly, list(by)).filter(F.col("past_year") < F.col("year"))
    both = own.withColumn("t", F.lit(None).cast(dict(targets.dtypes)["t"])).unionByName(targets.select("t", *RACE, *by), allowMissingColumns=True)
    so_far = Window.partitionBy(*by, "year").orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    same = both.select("t", "year", *by, F.col("year").alias("past_year"), *(F.sum(n).over(so_far).alias(n) for n in names)).filter(F.col("t").isNotNull() & (F.col("rows") > 0))
    return before.unionByName(same).select("t", *by, "past_year", *names)


def seen_by_entrants(targets: DataFrame, history: DataFrame) -> DataFrame:
    """t, driver, past_year with the target's entrants' own visits to its circuit before it: rows, known, places."""
    sums = {"known": F.count("position"), "places": F.sum("position")}
    return earlier_by_year(targets.select("t", *RACE, "driver", "circuit").distinct(), history, ("driver", "circuit"), sums)


def years_of(seen: DataFrame, targets: DataFrame, min_share: float) -> DataFrame:
    size = targets.groupBy("t").agg(F.countDistinct("driver").alias("entrants"))
    raced = seen.groupBy("t", "past_year").agg(F.count("*").alias("raced"))  # a row for each entrant
    return raced.join(size, "t").filter(F.col("raced") >= threshold(F.col("entrants"), min_share)).select("t", "past_year", "raced", "entrants")


def eligible_years_at(history: DataFrame, targets: DataFrame, min_share: float = 0.25) -> DataFrame:
    """(t, past_year, raced, entrants): for each entry list t, the years before its event in which enough of its entrants
    raced at the circuit.

    targets: t, year, round, circuit, driver; any number of lists, each with its own field and as-of event, which need not
    be in the history. Rows of history from that event on don't count for it.
    """
    return years_of(seen_by_entrants(targets, history), targets, min_share)


def events_of(history: DataFrame) -> DataFrame:
    """Every event as the list of its entrants, named by its number."""
    return history.join(calendar(history).select(*RACE, F.col("race_idx").alias("t")), list(RACE))


def eligible_years(history: DataFrame, min_share: float = 0.25) -> DataFrame:
    """(t, past_year): years in which enough of event t's entrants raced at its circuit before it."""
    return eligible_years_at(history, events_of(history), min_share)


def circuit_features(targets: DataFrame, history: DataFrame, min_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Over the years that count for each target: (t, driver, n, mean) and (t, circ_overtake, circ_dnf_rate, years)."""
    seen = seen_by_entrants(targets, history)
    years = years_of(seen, targets, min_share).select("t", "past_year")
    mine = seen.join(years, ["t", "past_year"], "left_semi").groupBy("t", "driver").agg(F.sum("known").alias("n"), F.try_divide(F.sum("places"), F.sum("known")).alias("mean"))
    gained = F.when((F.col("grid") > 0) & ~F.col("dnf"), F.col("grid") - F.col("position"))
    retired = F.col("dnf").cast("double")
    sums = {"g": F.sum(gained), "gn": F.count(gained), "d": F.sum(retired), "dn": F.count(retired)}
    there = earlier_by_year(targets.select("t", *RACE, "circuit").distinct(), history, ("circuit",), sums)
    field = there.join(years, ["t", "past_year"], "left_semi").groupBy("t").agg(
        F.try_divide(F.sum("g"), F.sum("gn")).alias("circ_overtake"), F.try_divide(F.sum("d"), F.sum("dn")).alias("circ_dnf_rate"), F.count("*").alias("years")
    )
    return mine, field


def priors(history: DataFrame, unknown: float = 10.5) -> DataFrame:
    """year, round, driver, prior: the entrant's mean of the last 20 counting events, else the field's of all so far."""
    races = calendar(history)
    idx = ranked(history, "driver").join(races.select(*RACE, "race_idx"), list(RACE))
    recent = last(F.col("position"), 20, "driver")
    ok_position = F.when(F.col("race_ok"), F.col("position"))
    by_race = idx.groupBy("race_idx").agg(F.sum(ok_position).alias("s"), F.count(ok_position).alias("c"), F.max(F.col("race_ok").cast("int")).alias("any"))
    earlier = Window.orderBy("race_idx").rowsBetween(Window.unboundedPreceding, -1)  # a row for each event
    field = by_race.select("race_idx", F.when(F.coalesce(F.max("any").over(earlier), F.lit(0)) == 0, F.lit(unknown)).otherwise(F.try_divide(F.sum("s").over(earlier), F.sum("c").over(earlier))).alias("field_mean"))
    return idx.withColumn("recent", recent).join(field, "race_idx").select(*RACE, "driver", F.coalesce("recent", "field_mean").alias("prior"))


def circuit_history_at(history: DataFrame, targets: DataFrame, prior: DataFrame, min_share: float = 0.25, weight: int = 3) -> DataFrame:
    """t, year, round, driver and the circuit's features for the entrants of each target; prior: as priors() gives it."""
    mine, field = circuit_features(targets, history, min_share)
    out = targets.select("t", *RACE, "driver").join(prior, [*RACE, "driver"]).join(mine, ["t", "driver"], "left").join(field, "t", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "t", *RACE, "driver", ((n * F.coalesce("mean", F.lit(0.0)) + weight * F.col("prior")) / (n + weight)).alias("circ_drv_finish"),
        n.alias("circ_drv_n"), "circ_overtake", "circ_dnf_rate", F.coalesce("years", F.lit(0)).alias("circ_n_years"),
    )


def circuit_history(history: DataFrame, min_share: float = 0.25, weight: int = 3, unknown: float = 10.5) -> DataFrame:
    """Means at the circuit over years that count, shrunk to the entrant's recent mean by `weight` events."""
    return circuit_history_at(history, events_of(history), priors(history, unknown), min_share, weight).drop("t")
