"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / w, where u comes from a seeded hash of its id and text and w is its
quality weight; sorting by the key samples without replacement in proportion to w. Within a source, documents are
taken in that order until the source's token budget is used: whole epochs (every document once) come first, then the
prefix of the order that fills the rest. Everything is DataFrame functions.

A source may hold any share of the rows: its order is cut into buckets of the key, so that sums per bucket give each
bucket's offset and the running sum within a bucket gives the rest. The key's scale by the least weight keeps a
bucket within 1 / MIN_WEIGHT times the mean.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share `share` times all tokens; a target
stops at `cap` times its source's size and the excess is shared again by weight. The fixed point of that is found in
one pass over sources sorted by cap / weight.

Defined cases: null texts have 0 words and are taken 0 times; null sources form one source; null ids hash like any
value; equal rows share a key and stand next to each other; an empty table gives an empty result; input columns named
like the result's are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.shared import aside, cut, restored, word_count

MIN_WEIGHT = 0.25


def quality_weight(text: Column) -> Column:
    """From MIN_WEIGHT to 1: the share of characters that aren't marks of junk, squared."""
    text = F.coalesce(text, F.lit(""))
    clean = F.length(F.translate(text, "#*$%&|<>!", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(MIN_WEIGHT), clean * clean)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """From (source, source_size) to (source, source_size, target)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    s = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    s = s.withColumn("is_capped", F.col("most") <= F.col("level") * F.col("w"))
    first = F.first(F.when(~F.col("is_capped"), F.col("level")), ignorenulls=True)
    s = s.withColumn("level", first.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, cut_last: bool = True, rows_per_bucket: int = 50_000) -> DataFrame:
    """The rows of docs with size, source_size, target, copies (whole times taken) and taken (words taken).

    With cut_last the document at the budget gives just the words still wanted; without it, it is taken whole if
    that comes nearer to the target, and else not at all.
    """
    held, names = aside(docs)
    text, source = F.col(names["text"]), F.col(names["source"])
    buckets = max(64, -(-docs.count() // rows_per_bucket))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), names["doc_id"], names["text"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    held = held.withColumn("size", word_count(text)).withColumn("source_", source)
    held = held.withColumn("key", -F.log(u) / quality_weight(text))
    held = held.withColumn("bucket", F.least(F.floor(F.lit(buckets) * (F.lit(1) - F.exp(-F.col("key") * MIN_WEIGHT))), F.lit(buckets - 1)).cast("long"))

    sums = cut(held.groupBy(F.col("source_").alias("source"), "bucket").agg(F.sum("size").alias("n")))
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    goals = goals.withColumnRenamed("source", "goal")
    sums = sums.join(goals, F.col("source").eqNullSafe(F.col("goal"))).select("source", F.col("bucket").alias("at"), "offset", "source_size", "target")

    within = Window.partitionBy("source_", "bucket").orderBy("key", names["doc_id"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = held.withColumn("run", F.sum("size").over(within))
    out = out.join(sums, F.col("source_").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("at")))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    start = F.col("offset") + F.col("run") - F.col("size")
    if cut_last:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.round(rest).cast("long") - start))
        more = (part == F.col("size")) & (F.col("size") > 0)
    else:
        more = (start + F.col("size") / 2 <= rest) & (F.col("size") > 0)
        part = F.when(more, F.col("size")).otherwise(0)
    out = out.withColumn("part", part.cast("long")).withColumn("copies", (F.when(F.col("size") > 0, F.col("epochs")).otherwise(0) + more.cast("int")).cast("int"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return restored(out, names, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=F.col("copies"), taken=taken)
