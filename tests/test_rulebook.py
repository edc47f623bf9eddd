"""What each target may know, whatever columns are called."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.operators import form, rulebook
from paceline.operators.rulebook import StageError, checked, derive, feature_columns, feature_table, mark
from tests.test_form import COLUMNS, row


@pytest.fixture(scope="module")
def history(spark):
    rows = [row(y, r, d, float(p), t, no=p, circuit=r % 2, quali_gap=p / 2, grid=float(p % 3)) for y in (2019, 2020) for r in (1, 2, 3) for p, (d, t) in enumerate((("a", "n"), ("b", "n"), ("c", "s")))]
    return spark.createDataFrame(rows, COLUMNS).coalesce(1).persist()


@pytest.fixture(scope="module")
def everything(history):
    return feature_table(history, "finish", ("recency", "post_practice", "scenario"))


def test_numbers_of_features(history):
    count = lambda *a, **k: len(feature_table(history, *a, **k).columns) - 4
    assert [count(t) for t in ("finish", "dnf", "quali", "qgap", "grid")] == [24, 24, 21, 21, 21]
    assert count("finish", with_grid=False) == 21
    assert count("quali", ("recency",)) == 30 and count("quali", ("recency",), half_life=4) == 24


def test_half_lives_are_chosen(everything):
    got = feature_columns(everything, "finish", ("recency",), half_life=8)
    assert [c for c in got if "_ew" in c] == ["drv_qgap_ew8", "drv_quali_ew8", "team_qgap_ew8"] and "grid" in got
    assert "grid" not in feature_columns(everything, "finish", ("recency",), 8, with_grid=False)
    with pytest.raises(ValueError, match="half-life of 3"):
        feature_columns(everything, "finish", ("recency",), half_life=3)


@pytest.mark.parametrize("hide", [
    lambda df: df.withColumnRenamed("wx_rain_frac", "drv_luck"),
    lambda df: df.select("year", "round", "driver", F.col("wx_rain_frac").alias("drv_luck")),
    lambda df: df.withColumn("drv_luck", F.col("wx_rain_frac")),
    lambda df: df.filter("year > 2019").withColumnRenamed("wx_rain_frac", "drv_luck").join(df.select("year", "round", "driver"), ["year", "round", "driver"]),
])
def test_weather_under_another_name_is_refused(everything, hide):
    frame = hide(everything)
    frame = frame.select(*(c for c in frame.columns if c in ("year", "round", "driver", "drv_luck")))
    with pytest.raises(StageError, match="drv_luck"):
        checked(frame, "quali")
    checked(frame, "finish", ("scenario",))


def test_derived_columns(everything):
    keys = everything.select("year", "round", "driver", "drv_finish_l5", "wx_rain_frac", "drv_n_l5")
    with pytest.raises(StageError, match="wet"):
        checked(keys.select("year", "round", "driver", (F.col("wx_rain_frac") * 1.0).alias("wet")), "quali")
    mixed = derive(keys, "wet", F.col("wx_rain_frac") * F.col("drv_n_l5"), "wx_rain_frac", "drv_n_l5").drop("wx_rain_frac")
    with pytest.raises(StageError, match="wet"):
        checked(mixed, "quali")
    plain = derive(keys, "total", F.col("drv_finish_l5") * F.col("drv_n_l5"), "drv_finish_l5", "drv_n_l5").drop("wx_rain_frac")
    assert checked(plain, "quali").columns[-1] == "total"
    with pytest.raises(Exception, match="wx_rain_frac"):
        derive(keys, "sly", F.col("wx_rain_frac"), "drv_n_l5")  # reads more than it says
    with pytest.raises(StageError):
        derive(keys, "constant", F.lit(1.0))


def test_what_targets_cannot_ask_for(history):
    for target in ("quali", "qgap", "grid"):
        with pytest.raises(StageError, match="scenario"):
            feature_table(history, target, ("scenario",))
        with pytest.raises(StageError, match="grid"):
            checked(mark(form.grid_features(history), "post_quali"), target)
    with pytest.raises(ValueError, match="no target"):
        feature_table(history, "podium")


def test_outcomes_of_targets(history):
    got = {t: rulebook.training_frame(history, t) for t in ("qgap", "grid", "quali")}
    assert sorted(r.y for r in got["qgap"].collect()) == sorted([0.0, 0.5, 1.0] * 6)
    assert sorted(r.y for r in got["grid"].collect()) == sorted([1.0, 2.0] * 6)  # a start from the pit lane is no slot
    assert got["quali"].count() == 18 and "grid" not in got["quali"].columns
