"""Evaluation of rankings: walk-forward splits, metrics as expectations under ties, bootstrap, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import uniform
from paceline.operators.form import RACE, average_rank, kept

METRICS = ("spearman", "mae_position", "winner_acc", "podium_overlap", "top10_overlap")


def walk_forward(history: DataFrame, locked: tuple[int, ...] = (2001,), least: int = 1) -> DataFrame:
    """Each test season with the number of earlier seasons to train on; locked seasons aren't tested."""
    seasons = history.select("year").distinct()
    train = seasons.select(F.col("year").alias("train"))
    pairs = seasons.filter(~F.col("year").isin(*locked)).join(train, F.col("train") < F.col("year"))  # seasons, not rows
    return pairs.groupBy("year").agg(F.count("*").alias("train_seasons"), F.min("train").alias("first_train"), F.max("train").alias("last_train")).filter(F.col("train_seasons") >= least)


def better_and_tied(value: str, *by: str) -> tuple[Column, Column]:
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) - 1, F.count("*").over(Window.partitionBy(*by, value))


def expected_in(n: int, better: Column, tied: Column) -> Column:
    """The chance to be among the first n if ties are broken at random."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - better) / tied))


def mean_distance(bp: Column, tp: Column, ba: Column, ta: Column) -> Column:
    """The mean of |i - j| for i in the places bp+1..bp+tp and j in ba+1..ba+ta, in closed form.

    Places i before all j or behind them are as far from these, on average, as the means are apart. For the n places among
    the j, with means c apart, it is (c^2 + (n^2 - 1) / 12 + (ta^2 - 1) / 4) / ta. So the cost doesn't depend on the ties.
    """
    bp, tp, ba, ta = (c.cast("double") for c in (bp, tp, ba, ta))
    none = F.lit(0.0)
    before = F.greatest(none, F.least(tp, ba - bp))
    behind = F.greatest(none, F.least(tp, bp + tp - ba - ta))
    among = tp - before - behind
    middle = ba + (ta + 1) / 2
    below = before * (middle - bp - (before + 1) / 2)
    above = behind * (bp + tp - (behind - 1) / 2 - middle)
    apart = bp + before + (among + 1) / 2 - middle
    inside = among * (apart * apart + (among * among - 1) / 12 + (ta * ta - 1) / 4) / ta
    return (below + above + inside) / tp


def race_metrics(scores: DataFrame, actual: DataFrame) -> DataFrame:
    """Metrics of each (model, event) with at least two known outcomes. actual: year, round, driver, position."""
    known = scores.join(actual.filter(F.col("position").isNotNull()), [*RACE, "driver"])
    by = ("model", *RACE)
    bp, tp = better_and_tied("score", *by)
    ba, ta = better_and_tied("position", *by)
    x = known.select(*by, average_rank(F.col("score"), *by).alias("rp"), average_rank(F.col("position"), *by).alias("ra"), bp.cast("int").alias("bp"), tp.cast("int").alias("tp"), ba.cast("int").alias("ba"), ta.cast("int").alias("ta"))
    n = F.count("*")
    cov = F.avg(F.col("rp") * F.col("ra")) - F.avg("rp") * F.avg("ra")
    spread = F.sqrt(F.var_pop("rp") * F.var_pop("ra"))

    def overlap(k: int) -> Column:
        both = expected_in(k, F.col("bp"), F.col("tp")) * expected_in(k, F.col("ba"), F.col("ta"))
        return F.sum(both) / F.least(F.lit(k), n)

    return x.groupBy(*by).agg(
        n.alias("n"), F.when(spread > 1e-12, F.try_divide(cov, spread)).otherwise(0.0).alias("spearman"),
        F.avg(mean_distance(F.col("bp"), F.col("tp"), F.col("ba"), F.col("ta"))).alias("mae_position"),
        overlap(1).alias("winner_acc"), overlap(3).alias("podium_overlap"), overlap(10).alias("top10_overlap"),
    ).filter(F.col("n") >= 2)


def summary(per_race: DataFrame) -> DataFrame:
    """Means by model and season, and by model with season null, in one aggregation."""
    means = [F.avg(m).alias(m) for m in METRICS]
    return per_race.groupingSets([["model", "year"], ["model"]], "model", "year").agg(F.count("*").alias("races"), *means)


def coverage(per_race: DataFrame) -> DataFrame:
    """Models that lack events which others have, or repeat one: empty if all cover the same."""
    all_races = per_race.agg(F.countDistinct(*RACE).alias("all_races"))
    own = per_race.groupBy("model").agg(F.count("*").alias("rows"), F.countDistinct(*RACE).alias("races"))
    return own.join(F.broadcast(all_races), (F.col("rows") != F.col("races")) | (F.col("races") != F.col("all_races")))  # one row


def paired(per_race: DataFrame, model: str, base: str, metric: str = "spearman") -> DataFrame:
    a = per_race.filter(F.col("model") == model).select(*RACE, F.col(metric).alias("a"))
    b = per_race.filter(F.col("model") == base).select(*RACE, F.col(metric).alias("b"))
    return a.join(b, list(RACE)).select(*RACE, (F.col("a") - F.col("b")).alias("gain"))


def bootstrap(gains: DataFrame, n: int = 200, clustered: bool = False, seed: int = 1) -> DataFrame:
    """The mean gain and its 2.5 and 97.5 percentiles over n resamples of events.

    Resampling is an equi-join: draw d of sample i picks the event numbered by a hash of (seed, i, d). Clustered, the
    seasons are drawn first and then as many events within each.
    """
    gains = kept(gains)
    spark = gains.sparkSession
    samples = spark.range(n).withColumnRenamed("id", "i")
    if not clustered:
        numbered = gains.select(F.row_number().over(Window.orderBy(*RACE)).alias("k"), "gain")  # a row per event
        total = numbered.agg(F.max("k").alias("total"))
        draws = samples.crossJoin(total).select("i", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("d"), "total")
        picked = draws.select("i", (F.floor(uniform(F.lit(seed), F.col("i"), F.col("d")) * F.col("total")) + 1).cast("int").alias("k"))
        means = picked.join(numbered, "k").groupBy("i").agg(F.avg("gain").alias("m"))
    else:
        seasons = gains.groupBy("year").agg(F.count("*").alias("races"))
        seasons = seasons.withColumn("s", F.row_number().over(Window.orderBy("year")))
        total = seasons.agg(F.max("s").alias("total"))
        drawn = samples.crossJoin(total).select("i", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("d"), "total")
        drawn = drawn.select("i", "d", (F.floor(uniform(F.lit(seed), F.col("i"), F.col("d")) * F.col("total")) + 1).cast("int").alias("s")).join(seasons, "s")
        draws = drawn.select("i", "d", "year", "races", F.explode(F.sequence(F.lit(1).cast("long"), F.col("races"))).alias("e"))
        picked = draws.select("i", "year", (F.floor(uniform(F.lit(seed), F.col("i"), F.col("d"), F.col("e")) * F.col("races")) + 1).cast("int").alias("k"))
        numbered = gains.select("year", F.row_number().over(Window.partitionBy("year").orderBy("round")).alias("k"), "gain")
        means = picked.join(numbered, ["year", "k"]).groupBy("i").agg(F.avg("gain").alias("m"))
    mean = gains.agg(F.avg("gain").alias("mean_gain"))
    bounds = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return mean.crossJoin(bounds)  # one row each


def leaderboard(per_race: DataFrame, base: str, metric: str = "spearman") -> DataFrame:
    """Each model's mean, its gain over the base model, and the seasons in which it is better."""
    b = per_race.filter(F.col("model") == base).select(*RACE, F.col(metric).alias("b"))
    both = per_race.join(b, list(RACE)).select("model", "year", F.col(metric).alias("m"), (F.col(metric) - F.col("b")).alias("g"))
    season = both.groupBy("model", "year").agg(F.sum("m").alias("m"), F.sum("g").alias("g"), F.count("*").alias("n"))
    return season.groupBy("model").agg(
        (F.sum("m") / F.sum("n")).alias(metric), (F.sum("g") / F.sum("n")).alias("gain"),
        F.sum((F.col("g") > 1e-9).cast("int")).alias("seasons_better"), F.count("*").alias("seasons"), F.sum("n").alias("races"),
    )


class LockedSeasonError(ValueError):
    """A season that is kept for the end was asked for."""


class TuningLeakError(ValueError):
    """Tuning would see a season that isn't for development."""


def check_not_locked(seasons: tuple[int, ...], locked: tuple[int, ...], allow: bool = False) -> None:
    if not allow and (met := sorted(set(seasons) & set(locked))):
        raise LockedSeasonError(f"seasons {met} are locked")


def development_only(rows: DataFrame, seasons: tuple[int, ...]) -> DataFrame:
    """The rows, all of which must be of these seasons: the data is looked at, not its label."""
    if outside := sorted(r.year for r in rows.filter(~F.col("year").isin(*seasons)).select("year").distinct().limit(5).collect()):
        raise TuningLeakError(f"seasons {outside} are not for development")
    return rows


def checked(per_race: DataFrame) -> DataFrame:
    """per_race, refused if a model lacks an event that others have or repeats one."""
    if bad := [r.model for r in coverage(per_race).select("model").limit(5).collect()]:
        raise ValueError(f"models {bad} were not scored once on each event")
    return per_race


def intervals(gains: DataFrame, n: int = 2000, clustered: bool = True, seed: int = 0) -> DataFrame:
    """(model, low, high): 2.5 and 97.5 percentiles of the mean gain of each model, with the same draws for all.

    gains: model, year, round, gain; all models have the same events, whose numbers are drawn as in bootstrap().
    """
    events = gains.select(*RACE).distinct()
    samples = gains.sparkSession.range(n).withColumnRenamed("id", "i")
    draw = lambda *parts: uniform(F.lit(seed), *parts)
    if clustered:
        seasons = events.groupBy("year").agg(F.count("*").alias("races")).withColumn("s", F.row_number().over(Window.orderBy("year")))
        total = seasons.agg(F.max("s").alias("total"))
        d = samples.join(F.broadcast(total)).select("i", "total", F.explode(F.sequence(F.lit(1), "total")).alias("d"))  # one row
        d = d.withColumn("s", (F.floor(draw(F.col("i"), F.col("d")) * F.col("total")) + 1).cast("int")).join(F.broadcast(seasons), "s")
        d = d.select("i", "d", "year", "races", F.explode(F.sequence(F.lit(1).cast("long"), "races")).alias("e"))
        picked = d.select("i", "year", (F.floor(draw(F.col("i"), F.col("d"), F.col("e")) * F.col("races")) + 1).cast("int").alias("k"))
        keys, order = ["year", "k"], Window.partitionBy("year").orderBy("round")
    else:
        total = events.agg(F.count("*").alias("total"))
        d = samples.join(F.broadcast(total)).select("i", "total", F.explode(F.sequence(F.lit(1).cast("long"), "total")).alias("d"))  # one row
        picked = d.select("i", (F.floor(draw(F.col("i"), F.col("d")) * F.col("total")) + 1).cast("int").alias("k"))
        keys, order = ["k"], Window.orderBy(*RACE)
    # how often each event was drawn for each sample, so that models meet counts and not draws
    times = picked.groupBy("i", *keys).agg(F.count("*").alias("times"))
    numbered = gains.join(events.withColumn("k", F.row_number().over(order)), list(RACE))  # a row per event
    means = times.join(numbered.select("model", *keys, "gain"), keys).groupBy("model", "i").agg((F.sum(F.col("gain") * F.col("times")) / F.sum("times")).alias("m"))
    return means.groupBy("model").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def best_of(per_race: DataFrame, among: tuple[str, ...], metric: str, smallest: bool = False) -> DataFrame:
    """One row: the model among these with the highest, or smallest, mean metric."""
    means = per_race.filter(F.col("model").isin(*among)).groupBy("model").agg(F.avg(metric).alias("m"))
    return means.agg((F.min_by if smallest else F.max_by)("model", "m").alias("best"))


def gains_over(per_race: DataFrame, best: DataFrame, metric: str) -> DataFrame:
    """model, year, round, gain of the metric over the model named by the one row of best."""
    base = per_race.join(F.broadcast(best), F.col("model") == F.col("best")).select(*RACE, F.col(metric).alias("b"))
    return per_race.join(base, list(RACE)).select("model", *RACE, (F.col(metric) - F.col("b")).alias("gain"))


def full_leaderboard(per_race: DataFrame, baselines: tuple[str, ...], metric: str = "spearman", n: int = 2000) -> DataFrame:
    """Models by their mean metric, highest first: all mean metrics, the gain over the best baseline with both
    intervals, and the seasons in which a model is better. One that clearly beats has its clustered interval above 0."""
    per_race = kept(per_race)
    means = per_race.groupBy("model").agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("races"))
    best = best_of(per_race, baselines, metric)
    gains = gains_over(per_race, best, metric)
    season = gains.groupBy("model", "year").agg(F.avg("gain").alias("g"))
    won = season.groupBy("model").agg(F.sum((F.col("g") > 0).cast("long")).alias("seasons_better"), F.count("*").alias("seasons"))
    out = means.join(won, "model").join(gains.groupBy("model").agg(F.avg("gain").alias("vs_best_baseline")), "model")
    for name, clustered in (("", True), ("iid_", False)):
        ci = intervals(gains, n, clustered)
        out = out.join(ci.select("model", F.col("low").alias(f"{name}ci_low"), F.col("high").alias(f"{name}ci_high")), "model")
    out = out.join(F.broadcast(best), F.lit(True)).withColumn("is_best", F.col("model") == F.col("best"))  # one row
    other = lambda c: F.when(~F.col("is_best"), F.col(c)).alias(c)
    return out.select(
        "model", F.col("model").isin(*baselines).alias("is_baseline"), *METRICS, "races", F.when(F.col("is_best"), 0.0).otherwise(F.col("vs_best_baseline")).alias("vs_best_baseline"),
        *(other(c) for c in ("ci_low", "ci_high", "iid_ci_low", "iid_ci_high")), "seasons_better", "seasons",
        (~F.col("is_best") & (F.col("vs_best_baseline") > 0)).alias("beats_best_baseline"), (~F.col("is_best") & (F.col("ci_low") > 0)).alias("clearly_beats"),
    ).orderBy(F.desc(metric), "model")


def relevance(position: Column, most: int = 23) -> Column:
    """A label for rankers: the better the place, the higher, 1 at least."""
    return F.greatest(most - position, F.lit(1.0))
