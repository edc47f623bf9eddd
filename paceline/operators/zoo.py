"""Models by board: what they predict, from which features, and the search of their features and settings.

A board is a target with the features that may be known of it. Every model of a board gets the columns that the rule book
gives for its variant, is fitted on all walk-forward folds at once, and is scored on the board's outcome, whatever it
was trained on: one that learns gaps in qualifying is scored on places.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators import boosting, harness, rulebook
from paceline.operators.evaluation import development_only, race_metrics
from paceline.operators.folds import walk_forward
from paceline.operators.forecast import LOG
from paceline.operators.form import RACE
from paceline.sources.files import append_log
from paceline.sources.scratch import written

KEYS = (*RACE, "driver")


@dataclass(frozen=True)
class Variant:
    """A ranker, what it is trained on and which features it gets."""

    ranker: str
    target: str = "finish"
    optional: tuple[str, ...] = ()
    half_life: int | None = None
    with_grid: bool = True
    settings: tuple[tuple[str, float], ...] = ()

    @property
    def name(self) -> str:
        """The ranker and what is unusual about it, such as ridge+gap+ew4."""
        parts = [self.ranker, *(["gap"] if self.target == "qgap" else []), *([f"ew{self.half_life}"] if self.half_life else [])]
        parts += ["practice"] * ("post_practice" in self.optional) + ["weather"] * ("scenario" in self.optional) + ["no_grid"] * (self.target in ("finish", "dnf") and not self.with_grid)
        return "+".join(parts + [f"{k}={v:g}" for k, v in self.settings])


#: By board, the outcome that is scored and what every model of it may ask for.
BOARDS = {
    "race": ("finish", Variant("", "finish")),
    "race_before_qualifying": ("finish", Variant("", "finish", with_grid=False)),
    "qualifying": ("quali", Variant("", "quali")),
    "qualifying_after_practice": ("quali", Variant("", "quali", ("post_practice",))),
}


def zoo(board: str, rankers: tuple[str, ...] = tuple(harness.RANKERS), half_lives: tuple[int, ...] = (4,)) -> list[Variant]:
    """The models of a board: each ranker as it is, races with the weather for trees, qualifying by gaps and with recent form."""
    _, plain = BOARDS[board]
    out = [replace(plain, ranker=r) for r in rankers]
    if board == "race":
        out += [replace(plain, ranker=r, optional=("scenario",)) for r in rankers if r == "boosted"]
    if plain.target == "quali":
        points = [r for r in rankers if r in ("ridge", "forest", "boosted")]  # what regresses can learn gaps
        out += [replace(plain, ranker=r, target="qgap") for r in points]
        out += [replace(plain, ranker=r, target=t, optional=(*plain.optional, "recency"), half_life=h) for r in points for t in ("quali", "qgap") for h in half_lives]
    return out


def tables(history: DataFrame, variants: list[Variant]) -> dict[Variant, tuple[DataFrame, list[str]]]:
    """For each variant its table (keys, race_ok, y, features) and features.

    Features of all stages that any of them asks for are computed and written once; a variant takes its columns by the
    rule book, which reads their stages from the written table's schema.
    """
    stages = tuple({s for v in variants for s in rulebook.allowed(v.target, v.optional)})
    targets = sorted({v.target for v in variants})
    outcomes = history.select(*KEYS, rulebook.marked(F.col("race_ok"), "race_ok", "key"), *(rulebook.marked(rulebook.outcome(t), f"y_{t}", "key") for t in targets))
    made = written(rulebook.all_features(history, stages).join(outcomes, list(KEYS)))
    out = {}
    for v in variants:
        names = rulebook.feature_columns(made, v.target, v.optional, v.half_life, v.with_grid)
        rulebook.checked(made.select(*names), v.target, v.optional)
        out[v] = made.select(*KEYS, "race_ok", F.col(f"y_{v.target}").alias("y"), *names), names
    return out


def scores(history: DataFrame, variants: list[Variant], seasons: tuple[int, ...] | None = None) -> DataFrame:
    """model, year, round, driver, score of every variant on every test season. A row for each of a season's entrants."""
    out = None
    for v, (table, names) in tables(history, variants).items():
        folds = walk_forward(table, "y", seasons)
        if not folds.of:
            raise ValueError("no season has one with results before it")
        given = dict(v.settings)
        args = (boosting.Settings(**{k: int(x) if float(x).is_integer() and k != "l2" else x for k, x in given.items()}),) if v.ranker in ("boosted", "lambdarank") and given else ()
        kw = given if not args else {}
        part = harness.RANKERS[v.ranker](table, tuple(names), "y", folds, *args, **kw).select(F.lit(v.name).alias("model"), *KEYS, "score")
        out = part if out is None else out.unionByName(part)
    return out


def board(history: DataFrame, name: str, rankers: tuple[str, ...] = tuple(harness.RANKERS), half_lives: tuple[int, ...] = (4,), seasons: tuple[int, ...] | None = None) -> DataFrame:
    """Metrics of each model of the board on each test event."""
    target, _ = BOARDS[name]
    history = written(history)
    actual = history.select(*KEYS, rulebook.outcome(target).alias("position"))
    return race_metrics(scores(history, zoo(name, rankers, half_lives), seasons), actual)


#: Settings that are searched: (board, ranker) have none of their own. Fixed values, simpler ones first.
TREES = {"leaves": (4.0, 8.0), "step": (0.1, 0.3), "l2": (1.0, 10.0)}
FEATURES = {"gap_target": (False, True), "recency": (None, 2, 4, 8)}


def grid(spark: SparkSession, values: dict[str, tuple]) -> list[dict]:
    """Every combination in order, by exploding one row once for each parameter."""
    trials = spark.range(1).select(F.lit(0).alias("trial_id"))
    for k, v in values.items():
        kind = "boolean" if isinstance(v[0], bool) else "int" if all(x is None or isinstance(x, int) for x in v) else "double"
        trials = trials.select("*", F.posexplode(F.array(*(F.lit(x).cast(kind) for x in v))).alias("_at", k)).withColumn("trial_id", F.col("trial_id") * len(v) + F.col("_at")).drop("_at")
    return [{k: r[k] for k in values} for r in trials.orderBy("trial_id").collect()]


def search(history: DataFrame, trials: list[tuple[Variant, dict]], target: str, seasons: tuple[int, ...], log: str | None = None) -> DataFrame:
    """One row a trial, in order, as forecast.tune gives them; appended to the log, if one is named.

    The first trial is chosen that none after it beats by more than 1e-12 in mean rank correlation, on development
    seasons only. All trials are scored in one job; a row of means for each reaches the driver.
    """
    shown = written(history.filter(F.col("year") <= max(seasons)))
    unique = {v.name: v for v, _ in trials}
    found = development_only(scores(shown, list(unique.values()), seasons), seasons)
    actual = shown.select(*KEYS, rulebook.outcome(target).alias("position"))
    means = {r.model: r for r in race_metrics(found, actual).groupBy("model").agg(F.avg("spearman").alias("mean"), F.count("*").alias("races")).collect()}
    rows, best = [], None
    for i, (v, params) in enumerate(trials):
        if v.name not in means:
            continue
        mean = float(means[v.name]["mean"])
        if best is None or mean > rows[best][4] + 1e-12:
            best = len(rows)
        rows.append((i, target, v.ranker, json.dumps(params, sort_keys=True), mean, int(means[v.name].races)))
    out = history.sparkSession.createDataFrame([(*r, k == best) for k, r in enumerate(rows)], LOG)
    if log is not None:
        append_log(out, log)
    return out


def tune_features(history: DataFrame, ranker: str, seasons: tuple[int, ...], log: str | None = None) -> DataFrame:
    """Whether the ranker of qualifying should learn gaps, and which recent form it should get."""
    trials = []
    for p in grid(history.sparkSession, FEATURES):
        recency = p["recency"]
        trials.append((Variant(ranker, "qgap" if p["gap_target"] else "quali", ("recency",) if recency else (), recency), p))
    return search(history, trials, "quali", seasons, log)


def tune_trees(history: DataFrame, seasons: tuple[int, ...], rounds: int = 10, ranker: str = "boosted", log: str | None = None) -> DataFrame:
    """Leaves, step and penalty of boosted trees for the race."""
    trials = [(Variant(ranker, settings=(*sorted(p.items()), ("rounds", rounds))), p) for p in grid(history.sparkSession, TREES)]
    return search(history, trials, "finish", seasons, log)
