"""What goes wrong at size: groups of equal rows, and scans that come in other partitions when read again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.llm import kneser_ney, suffix_dedup
from tests.llm.conftest import prose


def test_equal_rows_are_fetched_once(spark, monkeypatch):
    """Null ids and equal texts: one row's bytes stand for all."""
    passage = prose(5, 90)
    shared = prose(6, 60) + passage + prose(7, 60)
    rows = [(None, shared)] * 500 + [(1, prose(8, 60) + passage + prose(9, 60))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fetched = []
    monkeypatch.setattr(suffix_dedup, "contexts", lambda *a, f=suffix_dedup.contexts: fetched.append(f(*a)) or fetched[-1])
    got = suffix_dedup.dedup(frame, 100).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("lo"), F.max("n_removed").alias("hi"), F.max("n_bytes").alias("bytes")).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].n == 500 and by_id[None].lo == by_id[None].hi == by_id[None].bytes  # each is a copy of the others
    assert len(passage.encode()) <= by_id[1].hi < by_id[1].bytes
    [contexts] = fetched
    most = contexts.groupBy("a", "b", "anchor", "first").count().agg(F.max("count")).first()[0]
    assert contexts.count() < 100 and most <= 4


@pytest.mark.parametrize(("before", "after"), [("4", "2"), ("2", "7")])
def test_quality_rules_read_twice_under_other_parallelism(spark, tmp_path, monkeypatch, before, after):
    """Executors lost or gained between the two reads change nothing."""
    path = str(tmp_path / "docs")
    texts = [(i, prose(i, 80), "en" if i % 3 else "de", "s") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(20).write.parquet(path)
    want = sorted(tuple(r) for r in kneser_ney.rules(spark.read.parquet(path)).select("doc_id", "n_words", "kept", F.round("surprise", 6)).collect())
    settings = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in settings}
    monkeypatch.setattr(kneser_ney, "CHUNK", 2_000)

    def totals(parts, f=kneser_ney.totals):
        for k in settings:
            spark.conf.set(k, after)
        return f(parts)

    monkeypatch.setattr(kneser_ney, "totals", totals)
    try:
        for k in settings:
            spark.conf.set(k, before)
        got = sorted(tuple(r) for r in kneser_ney.rules(spark.read.parquet(path)).select("doc_id", "n_words", "kept", F.round("surprise", 6)).collect())
        assert got == want
        assert spark.conf.get(settings[0]) == after  # what others have set stays
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bands_are_the_same_in_every_run(spark):
    rows = [("en", False, float(i % 97) / 7, 10 + i % 50) for i in range(3000)] + [("de", False, 1.0, 5), (None, False, 2.0, 9), ("en", True, 99.0, 9), ("fr", False, None, 9)]
    frame = spark.createDataFrame(rows, "k string, base_failed boolean, surprise double, n_words long")
    seen = {tuple(sorted(map(str, kneser_ney.banded(frame.repartition(n)).collect()))) for n in (1, 3, 11)}
    assert len(seen) == 1
    of = {r.l: r for r in kneser_ney.banded(frame).collect()}
    values = sorted(round(r[2], 4) for r in rows[:3000])
    assert set(of) == {"en", "de", None} and of["en"].mid == pytest.approx((values[1499] + values[1500]) / 2) and of["de"].far == 0.02
