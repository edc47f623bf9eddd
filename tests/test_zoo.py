"""Boards, variants and the search of features and settings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paceline.operators import evaluation, rulebook, zoo
from paceline.operators.folds import walk_forward
from paceline.operators.harness import RANKERS
from paceline.operators.zoo import Variant
from paceline.sources.files import read_log
from paceline.sources.league import league
from paceline.sources.scratch import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    return written(league(spark, SF).filter("year <= 1998"))


def test_variants_of_boards():
    names = {b: [v.name for v in zoo.zoo(b)] for b in zoo.BOARDS}
    assert set(RANKERS) | {"boosted+weather"} == set(names["race"])
    assert {f"{r}+no_grid" for r in RANKERS} == set(names["race_before_qualifying"])
    assert {"ridge", "ridge+gap", "ridge+ew4", "ridge+gap+ew4", "forest+gap+ew4", "lambdarank"} <= set(names["qualifying"])
    assert {"ridge+practice", "boosted+gap+ew4+practice"} <= set(names["qualifying_after_practice"])
    assert all(len(n) == len(set(n)) for n in names.values())


def test_a_board_gives_models_what_they_may_know(history):
    variants = [Variant("ridge"), Variant("ridge", with_grid=False), Variant("ridge", "qgap", ("recency",), 4)]
    made = zoo.tables(history, variants)
    columns = [set(made[v][1]) for v in variants]
    assert columns[0] - columns[1] == {"grid", "grid_pit_lane", "grid_frac"} and "drv_qgap_ew4" in columns[2] and "grid" not in columns[2] and "drv_qgap_ew2" not in columns[2]


def test_boards_are_scored_on_their_own_outcome(history):
    """A model of gaps meets places; all models meet the same events."""
    got = zoo.board(history, "qualifying", ("ridge",), seasons=(1998,)).persist()
    assert {r.model for r in got.select("model").distinct().collect()} == {"ridge", "ridge+gap", "ridge+ew4", "ridge+gap+ew4"}
    assert evaluation.coverage(got).isEmpty()
    table, names = zoo.tables(history, [Variant("ridge", "qgap")])[Variant("ridge", "qgap")]
    alone = RANKERS["ridge"](table, tuple(names), "y", walk_forward(table, "y", (1998,))).select(F.lit("ridge+gap").alias("model"), "year", "round", "driver", "score")
    want = evaluation.race_metrics(alone, history.select("year", "round", "driver", rulebook.outcome("quali").alias("position")))
    a, b = ({(r.year, r.round): r.spearman for r in x.collect()} for x in (got.filter("model = 'ridge+gap'"), want))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_features_are_chosen_on_development_seasons(spark, history, tmp_path):
    log = str(tmp_path / "log")
    got = zoo.tune_features(history, "ridge", (1997,), log).orderBy("trial_id").collect()
    assert [json.loads(r.params) for r in got] == [{"gap_target": g, "recency": h} for g in (False, True) for h in (None, 2, 4, 8)]
    best = max(r.dev_spearman for r in got)
    assert [r.trial_id for r in got if r.chosen] == [next(r.trial_id for r in got if r.dev_spearman >= best - 1e-12)]
    other = written(history.withColumn("quali", F.when(F.col("year") < 1998, F.col("quali")).otherwise(26.0 - F.col("quali"))))
    assert [r.dev_spearman for r in zoo.tune_features(other, "ridge", (1997,), log).orderBy("trial_id").collect()] == [r.dev_spearman for r in got]
    assert read_log(spark, log, "trial_id int, target string, model string, params string, dev_spearman double, dev_races int, chosen boolean").count() == 16


def test_settings_of_trees(history, monkeypatch):
    monkeypatch.setattr(zoo, "TREES", {"leaves": (2.0, 3.0), "l2": (1.0, 10.0)})
    got = zoo.tune_trees(history.filter("year <= 1997"), (1997,), rounds=1).orderBy("trial_id").collect()
    assert [json.loads(r.params) for r in got] == [{"leaves": a, "l2": c} for a in (2.0, 3.0) for c in (1.0, 10.0)]
    assert sum(r.chosen for r in got) == 1
