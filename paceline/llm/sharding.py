"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash and writes them to the shared
folder. Pass 2 gathers one bucket at a time, applies a Fisher-Yates shuffle to it (Spark's `shuffle` of an array)
and numbers the rows: a row's place in the whole order is the bucket's offset plus its place in the bucket. Places
are cut into n_shards ranges, so the law `rows` holds: the counts of two shards differ by one at most, whatever
the texts, copies or ids. Everything is DataFrame functions.

A bucket holds about bucket_bytes; the number of buckets follows the input, so no task grows with it. The hash is that
of the id and the text, so another split of the files gives the same shards. Only rows that are equal in both, more of
them than a quarter of a bucket, would fill one: their hash also takes the row's number in the scan. The written first
pass fixes those numbers: a lost executor cannot change a row's bucket between the count and the shuffle.

Defined cases: a null text has size 8 and a null CRC; empty texts have size 8; a null doc_id is an id like others;
repeated rows each get a place of their own; an empty table gives an empty result; input columns named like the
result's (shard, slot, size, law) are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.shared import aside, cut, drop, restored


def n_buckets(spark, n_bytes: int, bucket_bytes: int, least_bytes: int = 1 << 20) -> int:
    """Memory-sized buckets; more and smaller ones, down to least_bytes, while that feeds more tasks."""
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n_bytes // bucket_bytes), min(tasks, -(-n_bytes // least_bytes)))


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 20, bucket_bytes: int = 32 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with size, law ('rows'), shard and slot. See the module's docstring."""
    spark = docs.sparkSession
    held, names = aside(docs)
    held = held.withColumn("size", F.coalesce(F.octet_length(names[text]), F.lit(0)).cast("long") + 8)
    held = held.withColumn("salt", F.xxhash64(F.lit(seed), names[key], names[text]))
    each = cut(held.groupBy("salt").agg(F.count("*").alias("n"), F.sum("size").alias("b")))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    buckets = n_buckets(spark, total.b, bucket_bytes)
    # at most four such groups for each bucket
    hot = cut(each.filter(F.col("n") * 4 * buckets > F.greatest(F.lit(total.n), F.lit(4 * buckets))).select(F.col("salt").alias("many")))
    drop(each)
    if not hot.isEmpty():
        spread = F.xxhash64("salt", F.monotonically_increasing_id())
        held = held.join(hot, F.col("salt") == F.col("many"), "left")
        held = held.withColumn("salt", F.when(F.col("many").isNotNull(), spread).otherwise(F.col("salt"))).drop("many")
    scattered = cut(held.withColumn("bucket", F.pmod(F.col("salt"), F.lit(buckets)).cast("int")))

    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    record = F.struct("salt", "size", *names.values())
    gathered = scattered.repartition(buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(record)).alias("rows"))
    mixed = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    placed = mixed.join(offsets, "bucket").select("offset", F.posexplode("rows").alias("pos", "row"))
    placed = placed.select((F.col("offset") + F.col("pos")).alias("place"), "row.*")

    placed = placed.withColumn("shard", F.expr(f"place * {n_shards}L div {max(total.n, 1)}L"))
    first = F.expr(f"(shard * {max(total.n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return restored(
        placed, names, size=F.col("size"), law=F.lit("rows"), shard=F.col("shard").cast("int"), slot=F.col("place") - first
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
