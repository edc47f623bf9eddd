"""Gradient-boosted trees from histograms that Spark sums, for regression and for ranking within events.

Features are cut into bins once. A round computes every row's gradient and hessian, and grows a tree: one aggregation by
(fold, node, feature, bin) gives the sums of all open nodes of all folds, and the driver, which sees leaves * features *
bins numbers and no rows, takes the split with the largest second-order gain

    GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)

with missing values on whichever side gains more. Trees grow best-first: of all leaves the one with the largest gain is
split next, up to a number of leaves. To need one job for a level and not one for a split, the nodes that could still
be chosen are split on trial, so that their children's sums are known before they are. All folds of a walk-forward
evaluation grow in the same jobs. Rows move between rounds in a table of the shared folder; a round's
trees are a constant of its plan, which doesn't grow with the number of rounds.

Ranking follows LambdaRank: the pull between two entrants of an event is the logistic loss of their scores times what
swapping them changes of the event's discounted gain, over pairs with at least one of the `top` best by the current
score. An entrant meets only those, so the work of an event is its field times `top`.

Defined cases: null and NaN features are missing; a feature without values is never split; rows with a null outcome are
scored but not learned from; a fold with one training row or equal outcomes gives a constant; ties in gain go to the
smaller feature, then the lower bin, then missing values on the left.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.folds import Folds, dealt
from paceline.operators.form import RACE
from paceline.sources.scratch import discard, written

KEYS = (*RACE, "driver")
NODES = "map<string, array<struct<feature int, cut int, missing_left boolean, left int, right int, value double, open boolean>>>"


@dataclass(frozen=True)
class Settings:
    rounds: int = 20
    step: float = 0.15
    leaves: int = 8
    depth: int = 5
    least_rows: int = 15
    l2: float = 1.0
    least_gain: float = 1e-9
    bins: int = 32
    top: int = 30  # ranking only
    sigma: float = 1.0  # ranking only


@dataclass
class Node:
    """A node of a tree. Until it is split its feature is -1."""

    depth: int
    g: float = 0.0
    h: float = 0.0
    split: tuple[float, int, int, bool] | None = None  # gain, feature, cut, missing_left
    sides: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # g and h to the left, g and h to the right
    known: bool = False
    feature: int = -1
    cut: int = 0
    missing_left: bool = True
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node(0)])
    taken: set[int] = field(default_factory=set)  # nodes whose split is part of the tree
    done: bool = False


# --- bins


def edges(rows: DataFrame, names: tuple[str, ...], bins: int) -> DataFrame:
    """(fold, edges): by feature the upper ends of its bins in the fold's training rows, ascending."""
    at = [i / bins for i in range(1, bins)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    found = rows.filter("train").groupBy("fold").agg(*(F.percentile_approx(value(c), at, 10_000).alias(f"e{i}") for i, c in enumerate(names)))
    some = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<double>"))))
    return found.select("fold", F.array(*(some(f"e{i}") for i in range(len(names)))).alias("edges"))


def binned(rows: DataFrame, names: tuple[str, ...], ends: DataFrame) -> DataFrame:
    """Adds bins: for each feature 0 for missing, else 1 and the number of edges below the value."""
    x = F.array(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names))
    number = F.transform(F.arrays_zip(x.alias("x"), F.col("edges").alias("e")), lambda z: F.when(z["x"].isNull(), 0).otherwise(F.size(F.filter(z["e"], lambda e: e < z["x"])) + 1))
    return rows.join(F.broadcast(ends), "fold").withColumn("bins", number).drop("edges")  # a row for each fold


# --- gradients


def squared(rows: DataFrame, s: Settings) -> DataFrame:
    """Gradient and hessian of half the squared error."""
    return rows.withColumn("g", F.col("pred") - F.col("y")).withColumn("h", F.lit(1.0))


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def lambdas(rows: DataFrame, s: Settings) -> DataFrame:
    """Gradient and hessian of LambdaRank by (fold, event): y is the gain of a label, larger for better, and larger
    scores are better. Equal scores rank by key."""
    event = ("fold", *RACE)
    w = Window.partitionBy(*event)
    # rows to be scored only have no part in the pulls, and rank among themselves
    by = Window.partitionBy(*event, "train")
    x = rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc("pred"), "driver")).cast("double"))
    ideal = F.row_number().over(by.orderBy(F.desc("y"), "driver"))
    x = x.withColumn("ideal", F.when(F.col("train") & (ideal <= s.top), F.col("y") * discount(ideal.cast("double"))).otherwise(0.0))
    x = x.withColumn("best", F.sum("ideal").over(w)).drop("ideal")
    seen = F.when(F.col("train") & (F.col("rank") <= s.top), F.struct("driver", "y", "pred", "rank"))
    x = x.withColumn("field", F.array_sort(F.collect_list(seen).over(w)))

    def pull(me: Callable[[str], Column], other: Column) -> tuple[Column, Column]:
        """Gradient and hessian of `me` from one pair."""
        worth = F.abs(me("y") - other["y"]) * F.abs(discount(me("rank")) - discount(other["rank"]))
        weight = F.when(F.col("best") > 0, worth / F.col("best")).otherwise(0.0)
        sign = F.signum(me("y") - other["y"])
        p = 1.0 / (1.0 + F.exp(s.sigma * sign * (me("pred") - other["pred"])))
        return -sign * s.sigma * weight * p, s.sigma**2 * weight * p * (1.0 - p)

    def summed(k: int) -> Column:
        return F.aggregate(F.filter("field", lambda o: o["driver"] != F.col("driver")), F.lit(0.0), lambda a, o: a + pull(F.col, o)[k])

    x = x.withColumn("g", F.when(F.col("train"), summed(0)).otherwise(0.0)).withColumn("h", F.when(F.col("train"), summed(1)).otherwise(0.0))
    # what rows behind the first ones pull at these
    behind = x.filter(F.col("train") & (F.col("rank") > s.top)).withColumn("o", F.explode("field"))
    g, h = pull(F.col, F.col("o"))
    pulled = behind.select(*event, F.col("o.driver").alias("driver"), (-g).alias("dg"), h.alias("dh")).groupBy(*event, "driver").agg(F.sum("dg").alias("dg"), F.sum("dh").alias("dh"))
    x = x.join(pulled, [*event, "driver"], "left")
    own = F.col("train") & (F.col("rank") <= s.top)
    add = lambda c: F.col(c) + F.when(own, F.coalesce(f"d{c}", F.lit(0.0))).otherwise(0.0)
    return x.withColumns({"g": add("g"), "h": add("h")}).drop("rank", "best", "field", "dg", "dh")


# --- trees


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing_left) of the best split; None if none gains. Arrays: features x bins, bin 0 missing."""
    total_g, total_h = g[0].sum(), h[0].sum()
    best = None
    for f in range(len(g)):
        for missing_left in (True, False):
            cg, ch, cn = (np.cumsum(np.where(np.arange(a.shape[1]) == 0, a[f] if missing_left else 0, a[f])) for a in (g, h, n))
            rows = n[f].sum()
            ok = (cn >= s.least_rows) & (rows - cn >= s.least_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = cg**2 / (ch + s.l2) + (total_g - cg) ** 2 / (total_h - ch + s.l2) - total_g**2 / (total_h + s.l2)
            gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
            at = int(gain.argmax())
            found = (float(gain[at]), f, at, missing_left)
            if found[0] > s.least_gain and (best is None or (found[0] > best[0] + 1e-12) or (abs(found[0] - best[0]) <= 1e-12 and (f, at) < (best[1], best[2]))):
                best = found
    return best


def chosen(tree: Tree, s: Settings) -> list[int]:
    """Takes splits best-first as far as sums are known; returns the nodes to be split on trial for the next job."""
    tree.taken = set()
    heap, leaves = [], 1
    push = lambda i: heapq.heappush(heap, (-tree.nodes[i].split[0], i)) if tree.nodes[i].split else None
    push(0)
    while heap and leaves < s.leaves:
        i = heap[0][1]
        node = tree.nodes[i]
        if node.left < 0:
            # only as many as there are splits left can be chosen
            return [k for _, k in heapq.nsmallest(s.leaves - leaves, heap) if tree.nodes[k].left < 0]
        heapq.heappop(heap)
        tree.taken.add(i)
        leaves += 1
        last = leaves == s.leaves
        if not last and not (tree.nodes[node.left].known and tree.nodes[node.right].known):
            return []
        push(node.left)
        push(node.right)
    tree.done = True
    return []


def split(tree: Tree, i: int, sums: tuple[float, float, float, float]) -> None:
    node = tree.nodes[i]
    _, node.feature, node.cut, node.missing_left = node.split
    for side, (g, h) in (("left", sums[:2]), ("right", sums[2:])):
        setattr(node, side, len(tree.nodes))
        tree.nodes.append(Node(node.depth + 1, g, h))


def node_of(bins: Column, nodes: Column, depth: int) -> Column:
    """The number of the node in which a row ends."""
    def down(i: Column, _: Column) -> Column:
        n = F.get(nodes, i)
        b = F.get(bins, n["feature"])
        left = F.when(b == 0, n["missing_left"]).otherwise(b <= n["cut"])
        return F.when(n["feature"] < 0, i).when(left, n["left"]).otherwise(n["right"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), down)


def as_column(trees: dict[int, Tree], open_nodes: dict[int, set[int]], s: Settings | None = None) -> Column:
    """The nodes of each row's fold, from a constant. With s, only splits that were taken, and the values of leaves."""
    out = {}
    for f, t in trees.items():
        nodes = out[str(f)] = []
        for i, n in enumerate(t.nodes):
            leaf = n.feature < 0 or (s is not None and i not in t.taken)
            value = -n.g / (n.h + s.l2) * s.step if s is not None and leaf and n.h + s.l2 > 0 else 0.0
            nodes.append({"feature": -1 if leaf else n.feature, "cut": int(n.cut), "missing_left": bool(n.missing_left), "left": n.left, "right": n.right, "value": float(value), "open": i in open_nodes.get(f, ())})
    return F.element_at(F.from_json(F.lit(json.dumps(out)), NODES), F.col("fold").cast("string"))


def histograms(rows: DataFrame, trees: dict[int, Tree], open_nodes: dict[int, set[int]], n_features: int, bins: int) -> dict[tuple[int, int], np.ndarray]:
    """{(fold, node): sums of g, h and rows by feature and bin}: one aggregation for all open nodes."""
    depth = max(n.depth for t in trees.values() for n in t.nodes)
    at = rows.filter("train").withColumn("nodes", as_column(trees, open_nodes))
    at = at.withColumn("node", node_of(F.col("bins"), F.col("nodes"), depth)).filter(F.get("nodes", F.col("node"))["open"])
    parts = at.select("fold", "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    sums = parts.groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.collect():  # folds * leaves * features * bins at most
        out.setdefault((r.fold, r.node), np.zeros((3, n_features, bins + 1)))[:, r.feature, r.bin] = r.g, r.h, r.n
    return out


def grow(rows: DataFrame, folds: list[int], n_features: int, s: Settings) -> dict[int, Tree]:
    """A tree for each fold, from the gradients in rows."""
    trees = {f: Tree() for f in folds}
    open_nodes = {f: {0} for f in folds}
    while any(open_nodes.values()):
        hist = histograms(rows, trees, open_nodes, n_features, s.bins)
        nodes = open_nodes
        open_nodes = {}
        for f, at in nodes.items():
            t = trees[f]
            for i in at:
                node, sums = t.nodes[i], hist.get((f, i))
                node.known = True
                if sums is None:
                    continue
                g, h, n = sums
                node.g, node.h = g[0].sum(), h[0].sum()
                node.split = best_split(g, h, n, s) if node.depth < s.depth else None
                if node.split:
                    _, k, c, left = node.split
                    own = np.arange(g.shape[1]) <= c
                    own[0] = left
                    node.sides = (g[k][own].sum(), h[k][own].sum(), g[k][~own].sum(), h[k][~own].sum())
            trial = chosen(t, s)
            for i in trial:
                split(t, i, t.nodes[i].sides)
            if trial:
                open_nodes[f] = {c for i in trial for c in (t.nodes[i].left, t.nodes[i].right)}
    for t in trees.values():
        chosen(t, s)
    return trees


def boost(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, s: Settings = Settings(), gradients: Callable[[DataFrame, Settings], DataFrame] = squared, log: list | None = None) -> DataFrame:
    """fold, year, round, driver, pred of the rows that each fold scores. table: year, round, driver, race_ok, y, names.

    log, if given, receives the trees of every round.
    """
    rows = dealt(table.select(*KEYS, "race_ok", F.col(y).cast("double").alias("y"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(names))), "y", folds)
    columns = tuple(f"x{i}" for i in range(len(names)))
    rows = binned(rows, columns, written(edges(rows, columns, s.bins))).drop(*columns, "race_ok")
    if gradients is squared:
        means = rows.filter("train").groupBy("fold").agg(F.avg("y").alias("pred"))
        rows = rows.join(F.broadcast(means), "fold")  # a row for each fold
    else:
        rows = rows.withColumn("pred", F.lit(0.0))
    state = written(gradients(rows, s))
    for _ in range(s.rounds):
        trees = grow(state, list(folds.fits), len(names), s)
        if log is not None:
            log.append(trees)
        if not any(t.taken for t in trees.values()):
            break
        depth = max(n.depth for t in trees.values() for n in t.nodes)
        moved = state.withColumn("nodes", as_column(trees, {}, s))
        moved = moved.withColumn("pred", F.col("pred") + F.get("nodes", node_of(F.col("bins"), F.col("nodes"), depth))["value"]).drop("nodes", "g", "h")
        new = written(gradients(moved, s))
        discard(state)
        state = new
    return state.filter("NOT train").select("fold", *KEYS, "pred")


def regression(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, s: Settings = Settings()) -> DataFrame:
    """year, round, driver, score: the outcome that boosted trees expect; lower is better."""
    return boost(table, names, y, folds, s).select(*KEYS, F.col("pred").alias("score"))


def lambdarank(table: DataFrame, names: tuple[str, ...], y: str, folds: Folds, s: Settings = Settings(), most: int = 23) -> DataFrame:
    """year, round, driver, score by LambdaRank on labels greatest(most - y, 1); lower is better."""
    labelled = table.withColumn(y, F.greatest(most - F.col(y), F.lit(1.0)))
    return boost(labelled, names, y, folds, s, lambdas).select(*KEYS, (-F.col("pred")).alias("score"))
