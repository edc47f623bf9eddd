"""As-of features of entrants and teams: what was known strictly before each event.

Every feature of every event is one window over the whole table instead of a loop over events. Rows of events that
don't count (race_ok false) get features like others, but never enter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACE = ("year", "round")
ERAS = (1995, 1998, 2000)


def kept(df: DataFrame) -> DataFrame:
    """df computed once: for small results that several later steps read. A checkpoint where the session has a folder for
    them, else in memory."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def before(history: DataFrame, year: int, rnd: int) -> DataFrame:
    """Rows of events strictly earlier than (year, rnd)."""
    return history.filter((F.col("year") < year) | ((F.col("year") == year) & (F.col("round") < rnd)))


def usable(history: DataFrame) -> DataFrame:
    """Rows of events that count. Fails at run time on a missing flag."""
    flag = F.when(F.col("race_ok").isNull(), F.raise_error(F.lit("race_ok is missing"))).otherwise(F.col("race_ok"))
    return history.filter(flag)


def unique_entries(history: DataFrame) -> DataFrame:
    """The history, refused if an entrant is listed twice in an event, a key is missing or a flag is null. One aggregation."""
    per = history.groupBy(*RACE, "driver").agg(F.count("*").alias("times"), F.count_if(F.col("race_ok").isNull()).alias("unflagged"))
    missing = F.col("year").isNull() | F.col("round").isNull() | F.col("driver").isNull()
    found = per.agg(F.count_if(F.col("times") > 1).alias("twice"), F.count_if(missing).alias("keyless"), F.sum("unflagged").alias("unflagged")).first()
    if faults := [f"{n} {what}" for n, what in ((found.twice, "entrants listed twice in an event"), (found.keyless, "rows without a key"), (found.unflagged, "rows without race_ok")) if n]:
        raise ValueError(", ".join(faults))
    return history


def usable_history(history: DataFrame) -> DataFrame:
    """Rows of events that count, of a history that is fit for features."""
    return unique_entries(history).filter("race_ok")


def duplicates(history: DataFrame) -> DataFrame:
    """Entrants listed more than once in an event."""
    return history.groupBy(*RACE, "driver").agg(F.count("*").alias("times")).filter("times > 1")


def calendar(history: DataFrame) -> DataFrame:
    """Each event with race_idx, its number from 1, and usable_before, how many counting events precede it.

    One row per event, so the unpartitioned window stays small whatever the number of entrants.
    """
    races = history.groupBy(*RACE).agg(F.bool_and("race_ok").alias("ok"))
    order = Window.orderBy(*RACE)
    earlier = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return races.select(*RACE, F.row_number().over(order).alias("race_idx"), F.coalesce(earlier, F.lit(0)).alias("usable_before"))


def _so_far(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(*RACE).rowsBetween(Window.unboundedPreceding, -1)


def ranked(history: DataFrame, entity: str, mask: Column | None = None, name: str = "k") -> DataFrame:
    """Adds k: the entity's counting rows before this one. Rows that don't count share k with the next that does."""
    ok = F.col("race_ok") if mask is None else F.col("race_ok") & mask
    return history.withColumn(name, F.coalesce(F.sum(ok.cast("int")).over(_so_far(entity)), F.lit(0)))


def last(values: Column, n: int, entity: str, k: str = "k", agg=F.avg) -> Column:
    """An aggregate of values over the entity's last n counting rows."""
    return agg(F.when(F.col("race_ok"), values)).over(Window.partitionBy(entity).orderBy(k).rangeBetween(-n, -1))


def share_to_date(history: DataFrame, entity: str) -> Column:
    """The entity's share of the season's points so far; null before any points, 0 for one that has raced before."""
    own = F.sum(F.when(F.col("race_ok"), F.col("points"))).over(_so_far("year", entity))
    raced = F.sum(F.col("race_ok").cast("int")).over(_so_far(entity)) > 0
    return F.when(F.col("season_points") > 0, F.when(raced, F.coalesce(own, F.lit(0.0))) / F.col("season_points"))


def with_season_points(history: DataFrame) -> DataFrame:
    """Adds season_points, those given in counting events of the season before this one."""
    races = history.groupBy(*RACE).agg(F.sum(F.when(F.col("race_ok"), F.col("points")).otherwise(0.0)).alias("p"))
    total = F.sum("p").over(Window.partitionBy("year").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    return history.join(races.select(*RACE, total.alias("season_points")), list(RACE))


def driver_form(history: DataFrame) -> DataFrame:
    h = ranked(with_season_points(history), "driver").join(calendar(history), list(RACE))
    grid = F.when(F.col("grid") > 0, F.col("grid"))
    latest = F.max(F.when(F.col("race_ok"), F.col("usable_before"))).over(_so_far("driver"))
    means = {"finish": F.col("position"), "grid": grid, "quali": F.col("quali"), "qgap": F.col("quali_gap"), "pace": F.col("pace_gap")}
    return h.select(
        *RACE, "driver", *(last(v, 5, "driver").alias(f"drv_{k}_l5") for k, v in means.items()),
        last(F.col("position"), 5, "driver", agg=F.count).alias("drv_n_l5"),
        last(F.col("dnf").cast("double"), 10, "driver").alias("drv_dnf_l10"),
        share_to_date(h, "driver").alias("drv_pts_share_ytd"),
        (F.col("usable_before") - 1 - latest).alias("drv_rounds_since_last"),
    )


def team_form(history: DataFrame) -> DataFrame:
    """Cars of a team are averaged within an event first."""
    cars = history.groupBy(*RACE, "team").agg(
        F.avg("position").alias("position"), F.avg("quali_gap").alias("quali_gap"), F.avg("pace_gap").alias("pace_gap"),
        F.avg(F.col("dnf").cast("double")).alias("dnf"), F.sum("points").alias("points"), F.bool_and("race_ok").alias("race_ok"),
    )
    h = ranked(with_season_points(cars), "team")
    return h.select(
        *RACE, "team", last(F.col("position"), 5, "team").alias("team_finish_l5"), last(F.col("quali_gap"), 5, "team").alias("team_qgap_l5"),
        last(F.col("pace_gap"), 3, "team").alias("team_pace_l3"), last(F.col("dnf"), 10, "team").alias("team_dnf_l10"),
        share_to_date(h, "team").alias("team_pts_share_ytd"),
    )


def decayed(rows: DataFrame, by: str, values: dict[str, str], half_lives: tuple[int, ...], block: int = 256) -> DataFrame:
    """year, round, by and, for each value and half-life h, the mean of earlier values weighted by 2^(-age / h).

    rows: year, round, by, usable_before, race_ok and the values. The target's age is a common factor of all weights and
    cancels in the ratio. So weights may count from any event: sums within a block of events count from its beginning,
    and each block carries the sums of those before it, decayed by the events between. No exponent grows with the
    history. What is older than 1000 half-lives weighs nothing in a double.
    """
    at = F.floor(F.col("usable_before") / block)
    x = rows.withColumn("block", at).withColumn("age", F.col("usable_before") - at * block)
    names = {(v, h): f"{n}_ew{h}" for v, n in values.items() for h in half_lives}
    sums = []
    for v, h in names:
        w = F.when(F.col("race_ok") & F.col(v).isNotNull(), F.pow(F.lit(2.0), F.col("age") / h))
        sums += [(f"w_{v}_{h}", w, h), (f"s_{v}_{h}", w * F.col(v), h)]
    blocks = x.groupBy(by, "block").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c, _ in sums))
    past = F.collect_list(F.struct("block", *(k for k, _, _ in sums))).over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))

    def carry(k: str, h: int) -> Column:
        return F.aggregate("past", F.lit(0.0), lambda a, b: a + b[k] * F.pow(F.lit(2.0), (b["block"] - F.col("block")) * block / h)).alias(f"c{k}")

    carried = blocks.select(by, "block", past.alias("past")).select(by, "block", *(carry(k, h) for k, _, h in sums))
    own = Window.partitionBy(by, "block").orderBy(*RACE).rowsBetween(Window.unboundedPreceding, -1)
    for k, c, _ in sums:
        x = x.withColumn(k, F.coalesce(F.sum(c).over(own), F.lit(0.0)))
    x = x.join(carried, [by, "block"])
    ratio = lambda v, h: F.try_divide(F.col(f"s_{v}_{h}") + F.col(f"cs_{v}_{h}"), F.col(f"w_{v}_{h}") + F.col(f"cw_{v}_{h}"))
    return x.select(*RACE, by, *(ratio(v, h).alias(n) for (v, h), n in names.items()))


def recency_form(history: DataFrame, half_lives: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Exponentially weighted means of entrants and of their teams, whose cars are averaged within an event first; age
    is counted in events of the calendar, not of the entrant."""
    races = calendar(history).select(*RACE, "usable_before")
    h = history.join(races, list(RACE))
    own = decayed(h, "driver", {"quali_gap": "drv_qgap", "quali": "drv_quali"}, half_lives)
    cars = history.groupBy(*RACE, "team").agg(F.avg("quali_gap").alias("quali_gap"), F.bool_and("race_ok").alias("race_ok"))
    team = decayed(cars.join(races, list(RACE)), "team", {"quali_gap": "team_qgap"}, half_lives)
    return history.select(*RACE, "driver", "team").join(own, [*RACE, "driver"]).join(team, [*RACE, "team"]).drop("team")


def context(history: DataFrame, eras: tuple[int, ...] = ERAS) -> DataFrame:
    """Round of the season, and seasons since rules last changed."""
    start = F.array_max(F.filter(F.array(*map(F.lit, eras)), lambda e: e <= F.col("year")))
    return history.select(*RACE).distinct().select(*RACE, F.col("round").alias("season_round"), (F.col("year") - start).alias("seasons_since_reg_change"))


def average_rank(value: Column, *by: str) -> Column:
    """Rank from 1 within by, ties sharing their mean; null for null."""
    w = Window.partitionBy(*by)
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), F.rank().over(w.orderBy(value.asc_nulls_last())) + (ties - 1) / 2)


def others_mean(value: Column, *by: str) -> Column:
    """The mean of the others in by, null without any."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w) - value.isNotNull().cast("int")
    return F.when(n > 0, (F.sum(value).over(w) - F.coalesce(value, F.lit(0.0))) / n)


def weekend_pace(history: DataFrame, by: tuple[str, ...] = RACE) -> DataFrame:
    """by: the columns that tell one field of entrants from another."""
    best = F.col("fp_best_gap")
    return history.select(
        *by, "driver", best.alias("pq_fp_best_gap"), F.col("fp_last_gap").alias("pq_fp_last_gap"), average_rank(best, *by).alias("pq_fp_best_rank"),
        (best - others_mean(best, *by, "team")).alias("pq_fp_vs_teammate"),
    )


def weather(history: DataFrame) -> DataFrame:
    return history.select(*RACE, "wx_air_temp", "wx_rain_frac").distinct().withColumn("wx_is_wet", (F.col("wx_rain_frac") > 0).cast("double"))


def grid_features(history: DataFrame, by: tuple[str, ...] = RACE) -> DataFrame:
    """Pit-lane starts and unknown slots go behind the last slot of the field, which the columns `by` name."""
    w = Window.partitionBy(*by)
    slot = F.when(F.col("grid") > 0, F.col("grid"))
    grid = F.coalesce(slot, F.coalesce(F.max(slot).over(w), F.lit(0.0)) + 1)
    return history.select(*by, "driver", grid.alias("grid"), F.coalesce(F.col("grid") == 0, F.lit(False)).cast("double").alias("grid_pit_lane"), (grid / F.count("*").over(w)).alias("grid_frac"))


def with_grids(features: DataFrame, grids: DataFrame, column: str = "grid") -> DataFrame:
    """features with grid, grid_pit_lane and grid_frac as other slots have them, for entrants that these name.

    grids: year, round, driver and the slot, real or predicted. A missing slot goes behind the last one of the event.
    """
    shown = features.select(*RACE, "driver").join(grids.select(*RACE, "driver", F.col(column).cast("double").alias("grid")), [*RACE, "driver"], "left")
    others = [c for c in features.columns if c not in ("grid", "grid_pit_lane", "grid_frac")]
    return features.select(*others).join(grid_features(shown), [*RACE, "driver"])


#: Which groups of features each target may use, and those that must be asked for. Fixed rules.
STAGES = {
    "finish": ("pre_weekend", "recency", "post_practice", "scenario", "post_quali"),
    "dnf": ("pre_weekend", "recency", "post_practice", "scenario", "post_quali"),
    "quali": ("pre_weekend", "recency", "post_practice"),
}
OPTIONAL = ("recency", "post_practice", "scenario")
BUILDERS = {
    "pre_weekend": (driver_form, team_form, context),
    "recency": (recency_form,),
    "post_practice": (weekend_pace,),
    "scenario": (weather,),
    "post_quali": (grid_features,),
}


def feature_table(history: DataFrame, target: str = "finish", optional: tuple[str, ...] = ()) -> DataFrame:
    """Keys and all features that the target may use; optional groups must be named."""
    if refused := [s for s in optional if s not in STAGES[target]]:
        raise ValueError(f"{target} can't use {refused}")
    out = history.select(*RACE, "driver", "team", "race_ok")
    for stage in STAGES[target]:
        if stage in OPTIONAL and stage not in optional:
            continue
        for build in BUILDERS[stage]:
            part = build(history)
            keys = [c for c in (*RACE, "driver", "team") if c in part.columns]
            out = out.join(part, keys, "left")
    return out


def training_frame(history: DataFrame, target: str = "finish", optional: tuple[str, ...] = ()) -> DataFrame:
    """Counting rows with a known target y, and their features."""
    y = {"finish": F.col("position"), "quali": F.col("quali"), "dnf": F.col("dnf").cast("double")}[target]
    known = history.filter(F.col("race_ok")).select(*RACE, "driver", y.alias("y")).filter(F.col("y").isNotNull())
    return feature_table(history, target, optional).drop("race_ok").join(known, [*RACE, "driver"])


def score_entries(history: DataFrame, entries: DataFrame, build) -> DataFrame:
    """Features of an event that hasn't happened: its entries, without outcomes, behind the history. The entries must be of
    one event; serving.features_at takes those of many."""
    events = entries.select(*RACE).distinct().limit(2).collect()
    if len(events) != 1:
        raise ValueError("entries must be of one event")
    year, rnd = events[0]
    both = before(history, year, rnd).unionByName(entries, allowMissingColumns=True)
    return build(both).filter((F.col("year") == year) & (F.col("round") == rnd))
