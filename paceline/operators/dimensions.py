"""Dimension tables: the latest attributes and the span of appearances of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.form import RACE


def dimension(history: DataFrame, key: str, **latest: str) -> DataFrame:
    """One row per key: each attribute's last non-null value by event, first and last year, and rows."""
    when = F.struct(*RACE, "no")
    attributes = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(a) for a, c in latest.items()]
    return history.filter(F.col(key).isNotNull()).groupBy(key).agg(*attributes, F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n"))


def drivers(history: DataFrame) -> DataFrame:
    return dimension(history, "driver", code="code", team="team")


def teams(history: DataFrame) -> DataFrame:
    return dimension(history, "team", last_driver="driver")


def circuits(history: DataFrame) -> DataFrame:
    return dimension(history, "circuit", last_winner="driver")
