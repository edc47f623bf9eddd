"""A quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark columns. Shallow random trees are grown on labelled rows; every path from a
root to a node is a rule, a conjunction of bounds on statistics. A logistic regression with a lasso penalty weighs
the rules and leaves most out. What is left is one Spark column expression, so scoring is a projection.

Learning uses at most max_rows labelled rows, picked by a hash of the statistics' row id when there are more; that is
the only bound, scoring covers all rows.

Defined cases: null and empty texts have zero for every statistic and a score like others; rows without a label, and
labels other than 0 and 1, teach nothing; with labels of one class or none, or too few to split, every score is the
smoothed share of label 1; labels repeated for a document each count; an empty table gives an empty result; columns named like the
added ones are replaced.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import SPACES, aside, cut, restored, word_count


def statistics(text: Column) -> dict[str, Column]:
    """Name to statistic, all double and never null."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)

    def share(pattern: str) -> Column:
        return F.coalesce(F.try_divide(n - F.length(F.regexp_replace(text, pattern, "")), n), F.lit(0.0))

    words, lines = F.filter(F.split(text, rf"[{SPACES}]+"), lambda w: w != ""), F.split(text, "\n")
    size = word_count(text)
    found = {
        "chars": n,
        "words": size,
        "word_length": F.try_divide(n, size),
        "distinct_words": F.try_divide(F.size(F.array_distinct(words)), F.sqrt(size)),
        "distinct_share": F.try_divide(F.size(F.array_distinct(words)), size),
        "lines": F.size(lines),
        "distinct_lines": F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": F.try_divide(size, F.size(lines)),
        "upper": share(r"\p{Lu}++"),
        "digits": share(r"\d++"),
        "symbols": share(r"[#*$%&<>]++"),
        "bars": share(r"[|]++"),
        "shouts": share(r"[!?]++"),
        "stops": share(r"[.,;:]++"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in found.items()}


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, is upper, value) that all hold; an upper bound includes its value, a lower one doesn't."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        tests = [F.col(s) <= v if upper else F.col(s) > v for s, upper, v in self.bounds]
        return functools.reduce(operator.and_, tests)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    terms: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, over columns that hold the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.terms:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(printed: str, names: list[str]) -> list[Rule]:
    """All rules of a printed tree ensemble: for each test, the tests above it on its way from the root, and itself."""
    found: dict[Rule, None] = {}
    way: list[tuple[str, bool, float]] = []
    first: int | None = None
    for line in printed.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if m is None:
            if "Tree" in line:
                way, first = [], None
            continue
        first = len(m[1]) if first is None else first
        del way[len(m[1]) - first :]
        way.append((names[int(m[2])], m[3] == "<=", float(m[4])))
        tight: dict[tuple[str, bool], float] = {}
        for s, upper, v in way:
            tight[s, upper] = (min if upper else max)(v, tight.get((s, upper), v))
        found[Rule(tuple(sorted((s, upper, v) for (s, upper), v in tight.items())))] = None
    return list(found)


def learn(rows: DataFrame, names: list[str], label: str, max_rows: int = 100_000, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> Ensemble:
    """From rows with statistics and a label."""
    rows = rows.filter(F.col(label).isin(0, 1)).select(*names, F.col(label).cast("double").alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(counts.values())
    p = (counts.get(1.0, 0) + 1) / (total + 2)
    flat = Ensemble(math.log(p / (1 - p)), ())
    if len(counts) < 2:
        return flat
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    rows = cut(rows.select(array_to_vector(F.array(*names)).alias("x"), "y", *names))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed).fit(rows)
    rules = paths(forest.toDebugString, names)
    if not rules:  # too few rows to split
        return flat
    tested = cut(rows.select(array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("r"), "y"))
    fitted = LogisticRegression(featuresCol="r", labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(tested)
    return Ensemble(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients, strict=True) if w))


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", key: str = "doc_id", label: str = "quality", **options) -> DataFrame:
    """The rows of docs, without the text, with score. Learns from docs where learn_from holds, joined with labels by key.

    The statistics are written once, for both uses, beside the columns of docs without the text.
    """
    held, names = aside(docs.withColumn("_learn", F.coalesce(learn_from, F.lit(False))))
    stats = statistics(F.col(names[text]))
    used = [new for old, new in names.items() if old != text]
    base = cut(held.select(*used, *(c.alias(s) for s, c in stats.items())))
    marked = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("label_key"), F.col(label).alias("label"))
    known = base.filter(F.col(names["_learn"])).join(marked, F.col(names[key]) == F.col("label_key"))
    ensemble = learn(known, list(stats), "label", **options)
    kept = {old: new for old, new in names.items() if old not in (text, "_learn")}
    return restored(base, kept, score=ensemble.score())
