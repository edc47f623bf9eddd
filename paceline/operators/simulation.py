"""Outcome probabilities by Monte Carlo, references for them, and calibration.

Noise is a hash of (seed, event, simulation, entrant), so results don't depend on partitions or engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import brier, hashed_uniform, log_loss, normal
from paceline.operators.form import RACE, kept

EVENTS = {"win": 1, "podium": 3, "top10": 10}
RETIRED = 1e6
#: The settings that a search of the noise tries: exponents, and spreads as multiples of SPREAD places at AT_SCORE. Fixed values.
GAMMAS = (0.0, 0.5, 1.0)
STEPS = (0.4, 0.55, 0.75, 1.0, 1.3, 1.7, 2.2, 3.0)
SPREAD, AT_SCORE = 3.0, 8.0


def recent_dnf_rate(history: DataFrame, seasons: int = 2, unknown: float = 0.12) -> DataFrame:
    """For each event: the rate over counting rows of this and the last seasons before it, else of all before, else unknown."""
    races = history.groupBy(*RACE).agg(F.sum(F.when(F.col("race_ok"), F.col("dnf").cast("double"))).alias("s"), F.sum(F.col("race_ok").cast("int")).alias("c"))
    so_far = Window.orderBy(*RACE).rowsBetween(Window.unboundedPreceding, -1)
    races = races.withColumn("s_all", F.sum("s").over(so_far)).withColumn("c_all", F.sum("c").over(so_far))
    years = races.groupBy("year").agg(F.sum("s").alias("ys"), F.sum("c").alias("yc"))
    old = Window.orderBy("year").rangeBetween(Window.unboundedPreceding, -seasons - 1)
    years = years.select("year", F.coalesce(F.sum("ys").over(old), F.lit(0.0)).alias("os"), F.coalesce(F.sum("yc").over(old), F.lit(0)).alias("oc"))
    r = races.join(years, "year")
    recent = F.when(F.col("c_all") - F.col("oc") > 0, (F.col("s_all") - F.col("os")) / (F.col("c_all") - F.col("oc")))
    whole = F.when(F.col("c_all") > 0, F.col("s_all") / F.col("c_all"))
    return r.select(*RACE, F.coalesce(recent, whole, F.lit(unknown)).alias("dnf_rate"))


def _noise(field: DataFrame, n_sims: int, seed: int, draw, block: int = 250) -> DataFrame:
    """The random numbers of each entrant in each simulation: z (pace), u (retirement), v (order of the retired). They
    are draw(seed, event, simulation, entrant, name).

    Simulations are dealt in blocks: a block of an event stays in one task, whose windows need no further shuffle. The
    number of tasks is given, as what is dealt is small and would be coalesced into one task, which then has all
    simulations to sort.
    """
    n_blocks = (n_sims - 1) // block + 1
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    tasks = max(int(field.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * n_blocks)
    dealt = field.withColumn("block", blocks).repartition(tasks, *RACE, "block")
    sims = dealt.withColumn("sim", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.lit(n_sims), (F.col("block") + 1) * block))))
    key = [F.lit(seed), F.col("year"), F.col("round"), F.col("sim"), F.col("driver")]
    return sims.withColumn("z", normal(*key, F.lit("pace"), draw=draw)).withColumn("u", draw(*key, F.lit("dnf"))).withColumn("v", draw(*key, F.lit("order")))


def _placed(noise: DataFrame, sigma: Column, gamma: Column, *by: str) -> DataFrame:
    s = F.greatest(F.col("score"), F.lit(1.0))
    out = F.col("u") < F.col("p_dnf")
    x = noise.withColumn("retired", out).withColumn("key", F.when(out, RETIRED + F.col("v")).otherwise(F.col("score") + sigma * F.pow(s, gamma) * F.col("z")))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(*RACE, "block", "sim", *by).orderBy("key", "driver")))


def valid_field(field: DataFrame) -> DataFrame:
    """The field, refused at run time where a score is unknown or a chance isn't one."""
    bad = F.col("score").isNull() | F.isnan("score") | F.col("p_dnf").isNull() | ~F.col("p_dnf").between(0.0, 1.0)
    return field.withColumn("score", F.when(bad, F.raise_error(F.lit("a score is unknown or a chance is not in 0 to 1")).cast("double")).otherwise(F.col("score")))


def simulate(field: DataFrame, n_sims: int = 200, sigma: float = 0.8, gamma: float = 0.5, seed: int = 0, draw=hashed_uniform) -> DataFrame:
    """Places in each simulation. field: year, round, driver, score, p_dnf. Retired entrants come last in any order."""
    placed = _placed(_noise(valid_field(field), n_sims, seed, draw), F.lit(sigma), F.lit(gamma))
    return placed.select(*RACE, "sim", "driver", "retired", "place")


def probabilities(simulated: DataFrame) -> DataFrame:
    hits = [F.avg((F.col("place") <= n).cast("double")).alias(f"p_{k}") for k, n in EVENTS.items()]
    return simulated.groupBy(*RACE, "driver").agg(*hits, F.avg(F.col("retired").cast("double")).alias("p_dnf"), F.avg("place").alias("expected_place"))


def uniform_probabilities(field: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*RACE))
    return field.select(*RACE, "driver", *(F.least(F.lit(1.0), k / n).alias(f"p_{e}") for e, k in EVENTS.items()))


def fit_total(p: DataFrame, column: str, total: float, rounds: int = 20) -> DataFrame:
    """Scales an event's probabilities so that they sum to total and none is above 1.

    The fixed point of scaling and clipping again and again: with probabilities in falling order, the first m are 1,
    for the least m at which the scaled rest stays within 1. One window finds it for all events.
    """
    order = Window.partitionBy(*RACE).orderBy(F.desc(column), "driver")
    w = Window.partitionBy(*RACE)
    x = p.withColumn("i", F.row_number().over(order)).withColumn("rest", F.sum(column).over(order.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("want", F.least(F.lit(float(total)), F.count("*").over(w).cast("double")) - (F.col("i") - 1))
    x = x.withColumn("fits", (F.col("rest") > 0) & (F.col(column) * F.col("want") <= F.col("rest") * (1 + 1e-12)))
    x = x.withColumn("m", F.min(F.when(F.col("fits"), F.col("i"))).over(w))
    scale = F.max(F.when(F.col("i") == F.col("m"), F.try_divide("want", "rest"))).over(w)
    fitted = F.when(F.col("m").isNull() | (F.col("i") < F.col("m")), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col(column) * scale))
    return x.select(*RACE, "driver", fitted.alias(column))


def outcomes(history: DataFrame) -> DataFrame:
    place = F.col("position")
    return history.filter(place.isNotNull()).select(*RACE, "driver", *((place <= n).alias(f"y_{k}") for k, n in EVENTS.items()), F.col("dnf").alias("y_dnf"))


def losses(p: DataFrame, actual: DataFrame, events: tuple[str, ...] = ("win", "podium", "top10")) -> DataFrame:
    """Mean log-loss and Brier score of each event."""
    both = p.join(actual, [*RACE, "driver"])
    return both.groupBy(*RACE).agg(
        *(F.avg(log_loss(F.col(f"p_{e}"), F.col(f"y_{e}"))).alias(f"logloss_{e}") for e in events),
        *(F.avg(brier(F.col(f"p_{e}"), F.col(f"y_{e}"))).alias(f"brier_{e}") for e in events),
    )


def reliability(p: DataFrame, actual: DataFrame, event: str = "podium", bins: int = 10) -> DataFrame:
    """Bins of equal counts by probability, ties by key: mean forecast, rate of hits, rows.

    The number of a row in the whole order comes from counts of distinct probabilities, which are few, so no window
    sorts all rows in one task.
    """
    both = p.join(actual, [*RACE, "driver"]).select(*RACE, "driver", F.col(f"p_{event}").alias("p"), F.col(f"y_{event}").cast("double").alias("y"))
    counts = both.groupBy("p").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("p").alias("q"), ahead.alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    r = both.join(counts, F.col("p") == F.col("q")).withColumn("r", F.col("ahead") + F.row_number().over(Window.partitionBy("p").orderBy(*RACE, "driver")))
    b = F.when(F.col("total") > 1, F.greatest(F.ceil((F.col("r") - 1) * bins / (F.col("total") - 1)) - 1, F.lit(0))).otherwise(0)
    return r.withColumn("bin", b.cast("int")).groupBy("bin").agg(F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.count("*").alias("n"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def noise_search(field: DataFrame, actual: DataFrame, gammas: tuple[float, ...] = GAMMAS, steps: tuple[float, ...] = STEPS, n_sims: int = 4000, seed: int = 1000) -> DataFrame:
    """gamma, sigma, logloss: for each setting of the noise, the mean over events of the summed log-losses, best first.

    All settings meet the same random numbers, and all run in one job: the settings are a column.
    """
    settings = F.array(*(F.struct(F.lit(g).alias("gamma"), F.lit(SPREAD / AT_SCORE**g * s).alias("sigma")) for g in gammas for s in steps))
    noise = _noise(valid_field(field), n_sims, seed, hashed_uniform).select("*", F.inline(settings))
    placed = _placed(noise, F.col("sigma"), F.col("gamma"), "gamma", "sigma")
    hits = [F.avg((F.col("place") <= n).cast("double")).alias(f"p_{k}") for k, n in EVENTS.items()]
    p = placed.groupBy(*RACE, "driver", "gamma", "sigma").agg(*hits).join(actual, [*RACE, "driver"])
    loss = p.groupBy(*RACE, "gamma", "sigma").agg(sum(F.avg(log_loss(F.col(f"p_{e}"), F.col(f"y_{e}"))) for e in EVENTS).alias("loss"))
    return loss.groupBy("gamma", "sigma").agg(F.avg("loss").alias("logloss")).orderBy("logloss", "gamma", "sigma")


def chances(field: DataFrame, n_sims: int, sigma: float, gamma: float, seed: int = 0) -> DataFrame:
    """The simulated chances of the field; that of retiring is the field's own."""
    p = probabilities(simulate(field, n_sims, sigma, gamma, seed)).drop("p_dnf", "expected_place")
    return p.join(field.select(*RACE, "driver", "p_dnf"), [*RACE, "driver"])


def losses_of(models: dict[str, DataFrame], actual: DataFrame) -> DataFrame:
    """model, year, round, and log-loss and Brier score of all events, retirement among them."""
    out = None
    for name, p in models.items():
        part = losses(p, actual, (*EVENTS, "dnf")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def score_report(models: dict[str, DataFrame], actual: DataFrame, own: str, n: int = 2000) -> DataFrame:
    """event, model: mean losses, calibration error, and for `own` its difference to the best other model with its
    interval. It is clearly better if that lies below 0."""
    from paceline.operators.evaluation import best_of, gains_over, intervals

    models, actual = {k: kept(p) for k, p in models.items()}, kept(actual)
    per_race = kept(losses_of(models, actual))
    others = tuple(m for m in models if m != own)
    out = None
    for e in (*EVENTS, "dnf"):
        ece = None
        for name, p in models.items():
            part = calibration_error(reliability(p, actual, e)).withColumn("model", F.lit(name))
            ece = part if ece is None else ece.unionByName(part)
        best = best_of(per_race, others, f"logloss_{e}", smallest=True)
        diff = gains_over(per_race.filter(F.col("model").isin(own, *others)), best, f"logloss_{e}").filter(F.col("model") == own)
        ci = intervals(diff, n).join(diff.groupBy("model").agg(F.avg("gain").alias("vs_best")), "model")
        row = per_race.groupBy("model").agg(F.avg(f"logloss_{e}").alias("logloss"), F.avg(f"brier_{e}").alias("brier"), F.count("*").alias("races")).join(ece, "model")
        row = row.join(ci, "model", "left").join(F.broadcast(best), F.lit(True))  # one row
        part = row.select(
            F.lit(e).alias("event"), "model", "logloss", "brier", "ece", "races", F.when(F.col("model") == own, F.col("best")).alias("best_baseline"), F.col("vs_best").alias("vs_best_baseline"),
            F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), F.coalesce(F.col("high") < 0, F.lit(False)).alias("clearly_better"),
        )
        out = part if out is None else out.unionByName(part)
    return out
