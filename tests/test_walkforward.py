"""Boosted trees, LambdaRank and models fitted on all folds at once, against brute force and numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import boosting, folds, models, walkforward
from paceline.operators.boosting import Settings, Tree, best_split, chosen
from paceline.operators.evaluation import race_metrics
from paceline.sources.league import league
from paceline.sources.scratch import written

SF = "/root/testdata/sf0.001"
NAMES = ("a", "b", "c")
SCHEMA = "year int, round int, driver string, race_ok boolean, position double, a double, b double, c double"


def races(spark, seed=0, seasons=(2001, 2002, 2003), rounds=3, field=7):
    """A small league whose outcome follows from a and, not linearly, from b; some values and outcomes are unknown."""
    r = random.Random(seed)
    rows = []
    for year in seasons:
        for rnd in range(1, rounds + 1):
            strength = {d: (r.gauss(0, 1), r.gauss(0, 1), r.choice([0.0, 1.0])) for d in range(field)}
            place = sorted(strength, key=lambda d: strength[d][0] + abs(strength[d][1]) + r.gauss(0, 0.3))
            for d, (a, b, c) in strength.items():
                known = r.random() > 0.1
                rows.append((year, rnd, f"d{d}", (year + rnd) % 5 != 0, float(place.index(d) + 1) if known else None, a if r.random() > 0.15 else None, b if r.random() > 0.1 else float("nan"), c))
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def small(spark):
    table, rows = races(spark)
    return written(table), rows


# --- folds


def test_folds_share_fits(spark):
    rows = [(y, 1, "x", y != 2002, 1.0, 0.0, 0.0, 0.0) for y in (2001, 2002, 2003, 2004)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = folds.walk_forward(table, "position", locked=())
    assert got.of == {2002: 2001, 2003: 2001, 2004: 2003} and got.fits == (2001, 2003)
    dealt = {(r.fold, r.year, r.train) for r in folds.dealt(table, "position", got).collect()}
    assert dealt == {(2001, 2001, True), (2001, 2002, False), (2001, 2003, False), (2003, 2001, True), (2003, 2003, True), (2003, 2004, False)}
    with pytest.raises(ValueError, match="locked"):
        folds.walk_forward(table, "position", (2004,), locked=(2004,))
    assert folds.walk_forward(table.limit(0), "position").of == {}


# --- trees


def slow_best(rows, g, h, s):
    """Every split of every feature at every value, missing values on both sides."""
    score = lambda idx: sum(g[i] for i in idx) ** 2 / (sum(h[i] for i in idx) + s.l2)
    every, best = list(range(len(rows))), 0.0
    for f in range(len(rows[0])):
        for cut in sorted({r[f] for r in rows if r[f] is not None}) + [-math.inf]:
            for missing_left in (True, False):
                left = [i for i in every if (missing_left if rows[i][f] is None else rows[i][f] <= cut)]
                right = [i for i in every if i not in left]
                if min(len(left), len(right)) >= s.least_rows:
                    best = max(best, score(left) + score(right) - score(every))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_splits_equal_exhaustive_search(spark, seed):
    r = random.Random(seed)
    n = 24
    rows = [[r.choice([None, r.randint(0, 5), r.gauss(0, 2)]) for _ in NAMES] for _ in range(n)]
    s = Settings(bins=64, least_rows=r.choice([1, 3, 6]), l2=r.choice([0.0, 1.0, 5.0]), rounds=1, step=1.0, leaves=2)
    table = spark.createDataFrame([(2000, i, "x", True, r.gauss(0, 3), *(None if v is None else float(v) for v in row)) for i, row in enumerate(rows)] + [(2001, 1, "x", True, None, 1.0, 1.0, 1.0)], SCHEMA)
    y = [x.position for x in table.filter("year = 2000").orderBy("round").collect()]
    log = []
    boosting.boost(table, NAMES, "position", folds.Folds((2000,), {2001: 2000}), s, log=log).collect()
    mean = sum(y) / n
    [trees] = log
    root = trees[2000].nodes[0]
    want = slow_best(rows, [mean - v for v in y], [1.0] * n, s)
    assert (root.split[0] if root.split else 0.0) == pytest.approx(want, abs=1e-6)


def test_growth_is_best_first():
    """Of two leaves the one with the larger gain is split, however deep; a third split isn't taken."""
    t = Tree()
    t.nodes[0].split, t.nodes[0].known = (9.0, 0, 1, True), True
    s = Settings(leaves=4)
    assert chosen(t, s) == [0]
    boosting.split(t, 0, (1.0, 1.0, 2.0, 2.0))
    for i, gain in ((1, 1.0), (2, 5.0)):
        t.nodes[i].split, t.nodes[i].known = (gain, 0, 1, True), True
    assert sorted(chosen(t, s)) == [1, 2] and not t.done
    for i in (2, 1):
        boosting.split(t, i, (1.0, 1.0, 1.0, 1.0))
    for i, gain in ((3, 3.0), (4, 0.5), (5, 0.1), (6, 0.1)):
        t.nodes[i].split, t.nodes[i].known = (gain, 0, 1, True), True
    assert chosen(t, s) == [3] or sorted(chosen(t, s)) == [3]
    boosting.split(t, 3, (1.0, 1.0, 1.0, 1.0))
    chosen(t, s)
    assert t.taken == {0, 2, 3} and t.done


def plain_boost(train, test, s):
    """Trees grown split by split in Python: train of (values, y), test of values."""
    start = sum(y for _, y in train) / len(train)
    pred, out = [start] * len(train), [start] * len(test)
    for _ in range(s.rounds):
        g = [p - y for p, (_, y) in zip(pred, train, strict=True)]
        leaves = [(list(range(len(train))), list(range(len(test))), 0)]

        def best(idx):
            if not idx:
                return None
            score = lambda part: sum(g[i] for i in part) ** 2 / (len(part) + s.l2)
            found = None
            for f in range(len(train[0][0])):
                for cut in [-math.inf, *sorted({x for i in idx if (x := train[i][0][f]) is not None})]:
                    for missing_left in (True, False):
                        goes = lambda v: missing_left if v[f] is None else v[f] <= cut  # noqa: B023, E731
                        left = [i for i in idx if goes(train[i][0])]
                        if s.least_rows <= len(left) <= len(idx) - s.least_rows:
                            right = [i for i in idx if not goes(train[i][0])]
                            gain = score(left) + score(right) - score(idx)
                            if gain > s.least_gain and (found is None or gain > found[0] + 1e-12):
                                found = gain, f, cut, missing_left
            return found

        splits = [best(leaves[0][0])]
        while len(leaves) < s.leaves and any(splits):
            k = max((i for i in range(len(leaves)) if splits[i]), key=lambda i: splits[i][0])
            _, f, cut, missing_left = splits[k]
            idx, shown, depth = leaves[k]
            goes = lambda v: missing_left if v[f] is None else v[f] <= cut  # noqa: B023, E731
            parts = [([i for i in idx if goes(train[i][0]) == side], [i for i in shown if goes(test[i]) == side], depth + 1) for side in (True, False)]
            leaves[k : k + 1] = parts
            splits[k : k + 1] = [best(p[0]) if p[2] < s.depth else None for p in parts]
        for idx, shown, _ in leaves:
            value = -sum(g[i] for i in idx) / (len(idx) + s.l2) * s.step
            for i in idx:
                pred[i] += value
            for i in shown:
                out[i] += value
    return out


def clean(rows):
    return [(r[:3], r[3] and r[4] is not None, r[4], [None if v is None or v != v else v for v in r[5:]]) for r in rows]


def test_boosting_equals_plain_trees(spark, small):
    table, rows = small
    s = Settings(rounds=3, leaves=4, depth=3, least_rows=3, bins=128, step=0.5)
    f = folds.walk_forward(table, "position", locked=())
    got = {(r.year, r.round, r.driver): r.score for r in boosting.regression(table, NAMES, "position", f, s).collect()}
    known = clean(rows)
    want = {}
    for season, fit in f.of.items():
        test = [(k, x) for k, _, _, x in known if k[0] == season]
        out = plain_boost([(x, y) for k, ok, y, x in known if ok and k[0] <= fit], [x for _, x in test], s)
        want |= {k: v for (k, _), v in zip(test, out, strict=True)}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


# --- ranking


def slow_lambdas(field, top, sigma):
    """{driver: (g, h)} from all pairs with at least one among the first. field: (driver, y, pred)."""
    order = sorted(field, key=lambda e: (-e[2], e[0]))
    rank = {e[0]: i + 1 for i, e in enumerate(order)}
    gain = sorted((e[1] for e in field), reverse=True)[:top]
    best = sum(v / math.log2(i + 2) for i, v in enumerate(gain))
    out = {e[0]: [0.0, 0.0] for e in field}
    for a in field:
        for b in field:
            if a[1] <= b[1] or min(rank[a[0]], rank[b[0]]) > top:
                continue
            weight = (a[1] - b[1]) * abs(1 / math.log2(rank[a[0]] + 1) - 1 / math.log2(rank[b[0]] + 1)) / best
            p = 1 / (1 + math.exp(sigma * (a[2] - b[2])))
            for d, sign in ((a[0], -1), (b[0], 1)):
                out[d][0] += sign * sigma * weight * p
                out[d][1] += sigma**2 * weight * p * (1 - p)
    return out


@pytest.mark.parametrize("top", [2, 4, 30])
def test_ranking_gradients(spark, top):
    r = random.Random(top)
    rows = [(2000, 2000, e, f"d{d}", True, float(r.randint(1, 6)), r.choice([0.0, r.gauss(0, 1)])) for e in range(4) for d in range(9)]
    rows += [(2000, 2001, 1, f"d{d}", False, None, r.gauss(0, 1)) for d in range(5)]
    frame = spark.createDataFrame(rows, "fold int, year int, round int, driver string, train boolean, y double, pred double")
    got = {(x.year, x.round, x.driver): (x.g, x.h) for x in boosting.lambdas(frame, Settings(top=top, sigma=1.5)).collect()}
    assert len(got) == len(rows) and all(got[2001, 1, f"d{d}"] == (0.0, 0.0) for d in range(5))
    for e in range(4):
        want = slow_lambdas([(x[3], x[5], x[6]) for x in rows if x[4] and x[2] == e], top, 1.5)
        for d, (g, h) in want.items():
            assert got[2000, e, d] == (pytest.approx(g, abs=1e-9), pytest.approx(h, abs=1e-9))


def test_ranking_learns_what_a_line_cannot(spark):
    """The outcome depends on |b|: trees order entrants, differences of features don't."""
    table, _ = races(spark, 4, seasons=tuple(range(2001, 2006)), rounds=8, field=10)
    table = written(table.withColumn("a", F.lit(0.0)))
    f = folds.walk_forward(table, "position", (2005,), locked=())
    parts = walkforward.scores(table, NAMES, "position", f, ("pairwise",)).unionByName(boosting.lambdarank(table, NAMES, "position", f, Settings(rounds=8, least_rows=5)).select(F.lit("lambdarank").alias("model"), "year", "round", "driver", "score"))
    mean = {r.model: r.m for r in race_metrics(parts, table).groupBy("model").agg(F.avg("spearman").alias("m")).collect()}
    assert mean["lambdarank"] > mean["pairwise"] + 0.1


# --- linear models


def test_ridge_equals_each_fold_alone(spark, small):
    table, rows = small
    f = folds.walk_forward(table, "position", locked=())
    got = {(r.year, r.round, r.driver): r.score for r in walkforward.ridge(table, NAMES, "position", f, 2.0).collect()}
    known = clean(rows)
    for season, fit in f.of.items():
        train = [(x, y) for k, ok, y, x in known if ok and k[0] <= fit]
        x = np.array([[np.nan if v is None else v for v in r] for r, _ in train])
        fill = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), fill, x)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        y = np.array([v for _, v in train])
        z = (x - mean) / sd
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ y)
        for k, _, _, v in known:
            if k[0] == season:
                v = np.array([fill[i] if u is None else u for i, u in enumerate(v)])
                assert got[k] == pytest.approx(y.mean() + (v - mean) / sd @ w, abs=1e-8)


def test_a_feature_that_is_never_known(spark, small):
    table = small[0].withColumn("c", F.lit(None).cast("double"))
    f = folds.walk_forward(table, "position", locked=())
    for model in walkforward.RANKERS.values():
        args = (Settings(rounds=1),) if model in (boosting.regression, boosting.lambdarank) else ()
        assert all(r.score is not None and math.isfinite(r.score) for r in model(table, NAMES, "position", f, *args).collect())


def slow_plackett_luce(events, w):
    return sum(math.log(sum(math.exp(v @ w) for v in e[k:])) - e[k] @ w for e in events for k in range(len(e)))


def test_plackett_luce_derivatives(spark):
    r = np.random.default_rng(1)
    events = [r.normal(size=(n, 3)) for n in (5, 2, 1, 4)]
    rows = [(7, 2000, e, f"d{i}", float(i), x.tolist()) for e, m in enumerate(events) for i, x in enumerate(m)]
    frame = spark.createDataFrame(rows, "fold int, year int, round int, driver string, y double, v array<double>")
    plan = walkforward.plackett_luce_sums(frame, {7: np.zeros(3)}, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    at = lambda w: walkforward.collected(walkforward.plackett_luce_sums(frame, {7: w}, 3), 3)[7]
    w = np.array([0.3, -0.7, 0.2])
    loss, g, h = at(w)
    assert loss == pytest.approx(slow_plackett_luce(events, w), abs=1e-9)
    for i in range(3):
        d = np.eye(3)[i] * 1e-5
        assert g[i] == pytest.approx((slow_plackett_luce(events, w + d) - slow_plackett_luce(events, w - d)) / 2e-5, abs=1e-6)
        assert h[i] == pytest.approx((at(w + d)[1] - at(w - d)[1]) / 2e-5, abs=1e-6)


def test_newton_converges_and_says_so(spark, small):
    table, _ = small
    f = folds.walk_forward(table, "position", locked=())
    for model in (walkforward.plackett_luce, walkforward.pairwise):
        report = []
        model(table, NAMES, "position", f, report=report)
        for fold in f.fits:
            own = [s for s in report if s.fold == fold]
            assert own[-1].change < 1e-9 and own[-1].gradient < 1e-6 and [s.loss for s in own] == sorted((s.loss for s in own), reverse=True)


def test_logistic_equals_numpy(spark, small):
    table = written(small[0].withColumn("hit", F.col("position") <= 2))
    f = folds.walk_forward(table, "hit", locked=())
    got = {(r.year, r.round, r.driver): r.score for r in walkforward.logistic(table, ("a", "c"), "hit", f, 0.5).collect()}
    rows = [tuple(r) for r in table.select("year", "round", "driver", "race_ok", "hit", "a", "c").collect()]
    for season, fit in f.of.items():
        train = [r for r in rows if r[3] and r[4] is not None and r[0] <= fit]
        x = np.array([[np.nan if v is None else v for v in r[5:]] for r in train])
        fill = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), fill, x)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        z, y = np.c_[(x - mean) / sd, np.ones(len(x))], np.array([float(r[4]) for r in train])
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag([2.0, 2.0, 1e-9]), z.T @ (p - y) + np.array([2.0, 2.0, 1e-9]) * w)
        for r in rows:
            if r[0] == season:
                v = np.array([fill[i] if u is None else u for i, u in enumerate(r[5:])])
                assert got[r[:3]] == pytest.approx(1 / (1 + np.exp(-(((v - mean) / sd) @ w[:2] + w[2]))), abs=1e-6)


def test_a_fold_knows_nothing_later(spark, small):
    """Scores of a season don't change when its outcomes, and all later rows, do."""
    table, _ = small
    f = folds.walk_forward(table, "position", (2002,), locked=())
    other = written(table.withColumn("position", F.when(F.col("year") < 2002, F.col("position")).otherwise(F.lit(5.0) - F.col("position"))).filter("year <= 2002"))
    for name, model in walkforward.RANKERS.items():
        args = (Settings(rounds=2, least_rows=3),) if name in ("boosted", "lambdarank") else ()
        one, two = ({(r.year, r.round, r.driver): r.score for r in model(t, NAMES, "position", f, *args).collect()} for t in (table, other))
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_ridge_on_the_league(spark):
    """The same as fitting the fold of one season alone, in the older way."""
    history = written(league(spark, SF))
    table = written(models.rows(history))
    f = folds.walk_forward(table, "position", (1999,))
    got = {(r.year, r.round, r.driver): r.score for r in walkforward.ridge(table, models.FEATURES, "position", f).collect()}
    train = models.train_rows(table, "position", 1998)
    alone = models.ridge(train, models.standardised(train, models.FEATURES), "position")
    want = {(r.year, r.round, r.driver): r.s for r in table.filter("year = 1999").select("year", "round", "driver", alone.alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
