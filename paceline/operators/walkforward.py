"""Models fitted on every walk-forward fold at once.

Ridge regression needs no pass for a fold: products of the features, of flags of missing ones and of the outcome are
summed by season in one aggregation, and the sums of a fold are those of its seasons. What a fold's medians fill in and
its scale follow from these sums by linear maps. Logistic, pairwise and Plackett-Luce models take Newton steps, each of
which is one aggregation by fold. Only numbers of the size of the features, by fold, reach the driver.

Scores come from small tables of weights joined by fold; lower is better.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators import boosting
from paceline.operators.folds import Folds, dealt, usable
from paceline.operators.form import RACE
from paceline.sources.scratch import discard, written

KEYS = (*RACE, "driver")


@dataclass
class Scale:
    """What a fold's training rows say of the features: values filled in, means and deviations of the filled columns."""

    median: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


@dataclass
class Sums:
    """Sums of products of (values with 0 for missing, flags of missing values, 1, y) over a fold's training rows."""

    products: np.ndarray
    scale: Scale

    def standardised(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Products of the scaled features with each other and with y, and the mean of y."""
        f = len(self.scale.median)
        fill = np.zeros((f + 2, 2 * f + 2))  # filled and scaled features, 1, y as linear in what was summed
        for i in range(f):
            fill[i, i], fill[i, f + i], fill[i, 2 * f] = 1.0, self.scale.median[i], -self.scale.mean[i]
            fill[i] /= self.scale.deviation[i]
        fill[f, 2 * f] = fill[f + 1, 2 * f + 1] = 1.0
        p = fill @ self.products @ fill.T
        n = self.products[2 * f, 2 * f]
        return p[:f, :f], p[:f, f + 1], float(p[f, f + 1] / n) if n else 0.0


def number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def medians(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds) -> dict[int, np.ndarray]:
    """By fold, the training rows' medians, 0 for a feature that is never known."""
    found = dealt(table, y, folds).filter("train").groupBy("fold").agg(*(F.coalesce(F.percentile(number(c), 0.5), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(names)))
    return {r.fold: np.array([r[f"m{i}"] for i in range(len(names))]) for r in found.collect()}


def season_sums(table: DataFrame, names: tuple[str, ...], y: str) -> dict[int, np.ndarray]:
    """By season, the sums of products of Sums over the rows that may be learned from: one aggregation."""
    f = len(names)
    x = [F.coalesce(number(c), F.lit(0.0)) for c in names] + [number(c).isNull().cast("double") for c in names] + [F.lit(1.0), F.col(y).cast("double")]
    z = table.filter(usable(y)).select("year", F.array(*x).alias("z"))
    # a row for each factor that isn't 0, so that there is a sum for each other factor and not for each pair
    own = z.select("year", "z", F.posexplode("z").alias("i", "factor")).filter("factor <> 0")
    out: dict[int, np.ndarray] = {}
    for r in own.groupBy("year", "i").agg(*(F.sum(F.col("factor") * F.get("z", F.lit(j))).alias(f"p{j}") for j in range(2 * f + 2))).collect():
        out.setdefault(r.year, np.zeros((2 * f + 2, 2 * f + 2)))[r.i] = [r[f"p{j}"] for j in range(2 * f + 2)]
    return out


def fold_sums(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds) -> dict[int, Sums]:
    """The sums of every fold, as running sums over seasons."""
    by_season, middle, f = season_sums(table, names, y), medians(table, names, y, folds), len(names)
    out = {}
    for fold in folds.fits:
        p = sum((by_season[s] for s in sorted(by_season) if s <= fold), np.zeros((2 * f + 2, 2 * f + 2)))
        n, m = p[2 * f, 2 * f], middle[fold]
        mean = (p[2 * f, :f] + m * p[2 * f, f : 2 * f]) / n
        square = (np.diag(p)[:f] + m**2 * np.diag(p)[f : 2 * f]) / n  # a value is known or filled in, never both
        deviation = np.sqrt(np.maximum(square - mean**2, 0.0))
        out[fold] = Sums(p, Scale(m, mean, np.where(deviation > 1e-9 * np.maximum(1.0, np.abs(mean)), deviation, 1.0)))
    return out


def scaled(names: tuple[str, ...]) -> Column:
    """The features filled and scaled by the columns median, mean and deviation, as one array."""
    x = F.array(*(number(c) for c in names))
    parts = F.arrays_zip(x.alias("x"), F.col("median").alias("m"), F.col("mean").alias("a"), F.col("deviation").alias("d"))
    return F.transform(parts, lambda p: (F.coalesce(p["x"], p["m"]) - p["a"]) / p["d"])


def with_scale(rows: DataFrame, names: tuple[str, ...], scales: dict[int, Scale]) -> DataFrame:
    """Adds v, the scaled features of each row by its fold's scale."""
    given = [(f, s.median.tolist(), s.mean.tolist(), s.deviation.tolist()) for f, s in scales.items()]
    table = rows.sparkSession.createDataFrame(given, "fold int, median array<double>, mean array<double>, deviation array<double>")
    return rows.join(F.broadcast(table), "fold").withColumn("v", scaled(names)).drop("median", "mean", "deviation")  # a row for each fold


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear_scores(table: DataFrame, names: tuple[str, ...], folds: Folds, scales: dict[int, Scale], weights: dict[int, np.ndarray], start: dict[int, float] | None = None, y: str = "position") -> DataFrame:
    """year, round, driver, score of each fold's test rows."""
    rows = dealt(table, y, folds).filter("NOT train")
    given = [(f, w.tolist(), float((start or {}).get(f, 0.0))) for f, w in weights.items()]
    w = rows.sparkSession.createDataFrame(given, "fold int, w array<double>, start double")
    return with_scale(rows, names, scales).join(F.broadcast(w), "fold").select(*KEYS, (F.col("start") + dot("v", "w")).alias("score"))


def ridge(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, alpha: float = 10.0) -> DataFrame:
    sums = fold_sums(table, names, y, folds)
    weights, start = {}, {}
    for f, s in sums.items():
        a, b, start[f] = s.standardised()
        weights[f] = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    return linear_scores(table, names, folds, {f: s.scale for f, s in sums.items()}, weights, start, y)


# --- Newton steps by fold


@dataclass
class Step:
    """One Newton step of one fold: what was reached before it."""

    fold: int
    step: int
    loss: float
    gradient: float  # its largest component
    change: float  # the largest change of a weight


def collected(sums: DataFrame, n: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """fold -> loss, gradient, hessian from columns loss, g0.., h0_0.. of a table with a row for each fold."""
    out = {}
    for r in sums.collect():
        hess = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                hess[i, j] = hess[j, i] = r[f"h{i}_{j}"]
        out[r.fold] = float(r.loss), np.array([r[f"g{i}"] for i in range(n)]), hess
    return out


def newton(derivatives, folds: tuple[int, ...], n: int, penalty: dict[int, np.ndarray], steps: int = 25, tolerance: float = 1e-9) -> tuple[dict[int, np.ndarray], list[Step]]:
    """Weights by fold that minimise loss + penalty * w^2 / 2, and a report of all steps.

    derivatives(weights) -> {fold: (loss, gradient, hessian)}. All folds step in the same jobs, those that have
    converged no more. A step that makes the loss larger is halved.
    """
    weights, report = {f: np.zeros(n) for f in folds}, []
    before: dict[int, tuple[float, np.ndarray]] = {}
    moving = set(folds)
    change = dict.fromkeys(folds, 0.0)
    for step in range(steps):
        found = derivatives({f: weights[f] for f in moving})
        for f in sorted(moving):
            if f not in found:
                moving.discard(f)
                continue
            loss, g, h = found[f]
            loss += float(penalty[f] @ weights[f] ** 2) / 2
            g = g + penalty[f] * weights[f]
            if f in before and loss > before[f][0] + 1e-9 * abs(loss):
                weights[f] = (weights[f] + before[f][1]) / 2
                continue
            move = -np.linalg.lstsq(h + np.diag(penalty[f]), g, rcond=None)[0]
            change[f] = float(np.abs(move).max(initial=0.0))
            report.append(Step(f, step, loss, float(np.abs(g).max(initial=0.0)), change[f]))
            if change[f] < tolerance:
                moving.discard(f)
                continue
            before[f] = loss, weights[f]
            weights[f] = weights[f] + move
        if not moving:
            break
    return weights, report


def with_weights(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    given = [(f, w.tolist()) for f, w in weights.items()]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(given, "fold int, w array<double>")), "fold")  # a row for each fold


def plackett_luce_sums(rows: DataFrame, weights: dict[int, np.ndarray], n: int) -> DataFrame:
    """By fold: loss, gradient and hessian of the Plackett-Luce model, with v.w the strength of an entrant.

    rows: fold, year, round, driver, y, v. Entrants are ordered by y, equal ones by name. Whoever is left when a place
    is taken are the rows from there on, so the sums over them are reverse cumulative ones: windows, all of one sort.
    """
    event = Window.partitionBy("fold", *RACE)
    left = event.orderBy("y", "driver").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = with_weights(rows, weights).withColumn("s", dot("v", "w")).select("fold", *KEYS, "y", "s", *(F.get("v", F.lit(i)).alias(f"v{i}") for i in range(n)))
    e = s.withColumn("top", F.max("s").over(event)).withColumn("e", F.exp(F.col("s") - F.col("top")))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    x = e.select(
        "fold", "s", "top", *(f"v{i}" for i in range(n)), F.sum("e").over(left).alias("s0"), *(F.sum(F.col("e") * F.col(f"v{i}")).over(left).alias(f"a{i}") for i in range(n)),
        *(F.sum(F.col("e") * F.col(f"v{i}") * F.col(f"v{j}")).over(left).alias(f"b{i}_{j}") for i, j in pairs),
    )
    mean = lambda i: F.col(f"a{i}") / F.col("s0")
    return x.groupBy("fold").agg(
        F.sum(F.ln("s0") + F.col("top") - F.col("s")).alias("loss"), *(F.sum(mean(i) - F.col(f"v{i}")).alias(f"g{i}") for i in range(n)),
        *(F.sum(F.col(f"b{i}_{j}") / F.col("s0") - mean(i) * mean(j)).alias(f"h{i}_{j}") for i, j in pairs),
    )


def logistic_sums(rows: DataFrame, weights: dict[int, np.ndarray], n: int) -> DataFrame:
    """By fold: loss, gradient and hessian of logistic regression. rows: fold, v, y (0 or 1)."""
    z = with_weights(rows, weights).withColumn("z", dot("v", "w")).select("fold", "z", F.col("y").cast("double").alias("y"), *(F.get("v", F.lit(i)).alias(f"v{i}") for i in range(n)))
    p = z.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("z"))))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    spread = F.col("p") * (1.0 - F.col("p"))
    return p.groupBy("fold").agg(
        F.sum(F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")).alias("loss"),
        *(F.sum((F.col("p") - F.col("y")) * F.col(f"v{i}")).alias(f"g{i}") for i in range(n)), *(F.sum(spread * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"h{i}_{j}") for i, j in pairs),
    )


def training(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, scales: dict[int, Scale]) -> DataFrame:
    """fold, year, round, driver, y, v of the training rows of every fold, written once."""
    rows = with_scale(dealt(table, y, folds).filter("train"), names, scales)
    return written(rows.select("fold", *KEYS, F.col(y).cast("double").alias("y"), "v"))


def plackett_luce(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, penalty: float = 1.0, report: list | None = None) -> DataFrame:
    scales = {f: s.scale for f, s in fold_sums(table, names, y, folds).items()}
    rows, n = training(table, names, y, folds, scales), len(names)
    weights, steps = newton(lambda w: collected(plackett_luce_sums(rows, w, n), n), folds.fits, n, {f: np.full(n, penalty) for f in folds.fits})
    discard(rows)
    if report is not None:
        report.extend(steps)
    return linear_scores(table, names, folds, scales, {f: -w for f, w in weights.items()}, y=y)


def pairwise(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, penalty: float = 0.01, report: list | None = None) -> DataFrame:
    """Logistic regression without intercept on differences of two entrants of an event; penalty by pair."""
    scales = {f: s.scale for f, s in fold_sums(table, names, y, folds).items()}
    rows, n = training(table, names, y, folds, scales), len(names)
    other = rows.select("fold", *RACE, F.col("driver").alias("d2"), F.col("y").alias("y2"), F.col("v").alias("v2"))
    both = rows.join(other, ["fold", *RACE]).filter(F.col("driver") < F.col("d2"))  # pairs of one event's field
    pairs = written(both.select("fold", F.zip_with("v", "v2", lambda a, b: a - b).alias("v"), (F.col("y") > F.col("y2")).cast("double").alias("y")))
    size = {r.fold: r["count"] for r in pairs.groupBy("fold").count().collect()}
    weights, steps = newton(lambda w: collected(logistic_sums(pairs, w, n), n), folds.fits, n, {f: np.full(n, penalty * size.get(f, 0) + 1e-12) for f in folds.fits})
    discard(rows, pairs)
    if report is not None:
        report.extend(steps)
    return linear_scores(table, names, folds, scales, weights, y=y)


def logistic(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, c: float = 0.01, report: list | None = None) -> DataFrame:
    """The chance of y (a boolean or 0/1 column) by regularised logistic regression with an unpenalised intercept."""
    scales = {f: s.scale for f, s in fold_sums(table.withColumn(y, F.col(y).cast("double")), names, y, folds).items()}
    rows, n = training(table, names, y, folds, scales), len(names) + 1
    with_one = rows.withColumn("v", F.concat("v", F.array(F.lit(1.0))))
    keep = np.full(n, 1.0 / c)
    keep[-1] = 1e-9  # a fold of one class has no finite intercept
    weights, steps = newton(lambda w: collected(logistic_sums(with_one, w, n), n), folds.fits, n, dict.fromkeys(folds.fits, keep))
    discard(rows)
    if report is not None:
        report.extend(steps)
    z = linear_scores(table, names, folds, scales, {f: w[:-1] for f, w in weights.items()}, {f: w[-1] for f, w in weights.items()}, y)
    return z.withColumn("score", 1.0 / (1.0 + F.exp(-F.col("score"))))


#: Rankers by name; each fits all folds and returns year, round, driver, score.
RANKERS = {"ridge": ridge, "plackett_luce": plackett_luce, "pairwise": pairwise, "boosted": boosting.regression, "lambdarank": boosting.lambdarank}


def scores(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, rankers: tuple[str, ...] = tuple(RANKERS)) -> DataFrame:
    """model, year, round, driver, score of every ranker on every fold's test rows."""
    out = None
    for name in rankers:
        part = RANKERS[name](table, names, y, folds).select(F.lit(name).alias("model"), *KEYS, "score")
        out = part if out is None else out.unionByName(part)
    return out
