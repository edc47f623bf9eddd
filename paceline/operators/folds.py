"""Walk-forward folds: each season is scored by what was fitted on the seasons before it, all folds in the same jobs.

A fit is named by its last training season. Two test seasons that have the same training rows before them, because no
season between them has any, share a fit, so nothing is fitted twice on the same events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Folds:
    """fits: the last training season of each fit. of: the fit of each test season."""

    fits: tuple[int, ...]
    of: dict[int, int]

    @property
    def seasons(self) -> tuple[int, ...]:
        return tuple(sorted(self.of))


def usable(y: str) -> Column:
    """Whether a row may be learned from: its event counts and its outcome is known."""
    return F.coalesce(F.col("race_ok"), F.lit(False)) & F.col(y).isNotNull()


def walk_forward(table: DataFrame, y: str, seasons: tuple[int, ...] | None = None, locked: tuple[int, ...] = (2001,), allow_locked: bool = False) -> Folds:
    """The folds of the seasons named, else of all that aren't locked. One aggregation: a row for each season."""
    if seasons is not None and not allow_locked and (met := sorted(set(seasons) & set(locked))):
        raise ValueError(f"seasons {met} are locked")
    rows = {r.year: r.n for r in table.groupBy("year").agg(F.count_if(usable(y)).alias("n")).collect()}
    learned = sorted(s for s, n in rows.items() if n and s is not None)
    tested = [s for s in sorted(s for s in rows if s is not None) if (seasons is None or s in seasons) and (allow_locked or s not in locked)]
    of = {s: max(before) for s in tested if (before := [t for t in learned if t < s])}
    return Folds(tuple(sorted(set(of.values()))), of)


def dealt(table: DataFrame, y: str, folds: Folds) -> DataFrame:
    """The rows of each fold: those it learns from (train true) and those it scores (train false), with column fold.

    A row appears once for each fit that learns from it, so a table grows by the number of seasons at most.
    """
    each = [F.when(usable(y) & (F.col("year") <= f), F.struct(F.lit(f).alias("fold"), F.lit(True).alias("train"))) for f in folds.fits]
    scored = [F.when(F.col("year") == s, F.struct(F.lit(f).alias("fold"), F.lit(False).alias("train"))) for s, f in folds.of.items()]
    return table.withColumn("_fold", F.explode(F.array_compact(F.array(*each, *scored)))).select("*", "_fold.fold", "_fold.train").drop("_fold")
