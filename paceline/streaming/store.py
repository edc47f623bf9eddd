"""A store of session tables that takes each session once, whole, or not at all.

An ingest looks at the sessions that are announced and not yet in the ledger, copies what was delivered of them,
validates every table of the copies, writes the tables of the sessions that pass, each session replacing its own
partitions, and only then adds their rows to the ledger. Readers see sessions of the ledger only. So whatever stops a run
leaves sessions that the next run does again, and a run with nothing new writes nothing. A session with an empty table that
isn't allowed to be missing, or with rows that lack what is required, is refused and tried again by the next run.

All sessions go through one plan for each table; what reaches the driver is whether there are any. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources.files import KEYS
from paceline.sources.scratch import discard, written

LEDGER = "year INT, round INT, session STRING, counts MAP<STRING, BIGINT>, missing ARRAY<STRING>, ingested_at TIMESTAMP, batch STRING"
Step = Callable[[str], None]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The sessions that are done, with the rows of each table and the tables they lack."""
    if not _exists(spark, f"{root}/_ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/_ledger")


def pending(sessions: DataFrame, done: DataFrame) -> DataFrame:
    return sessions.select(*KEYS).distinct().join(done, list(KEYS), "left_anti")


def stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's rows of the sessions in the ledger: leftovers of runs that were stopped don't show."""
    own = ledger(spark, root).filter(F.coalesce(F.try_element_at("counts", F.lit(table)), F.lit(0)) > 0)
    return spark.read.parquet(f"{root}/{table}").join(own.select(*KEYS), list(KEYS), "left_semi")


def verdicts(todo: DataFrame, staged: dict[str, DataFrame], allowed: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """year, round, session, counts, missing, refused (reasons, empty if it passes) of every session of todo."""
    per = None
    for name, rows in staged.items():
        lacks = [F.col(c).isNull() for c in required.get(name, ())]
        bad = F.count_if(lacks[0] if len(lacks) == 1 else _any(lacks)) if lacks else F.lit(0).cast("long")
        part = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), bad.alias("bad")).select(*KEYS, F.lit(name).alias("table"), "n", "bad")
        per = part if per is None else per.unionByName(part)
    every = todo.select(*KEYS, F.explode(F.array(*map(F.lit, staged))).alias("table"))
    may = allowed.select(*KEYS, "table", F.lit(True).alias("may")).distinct()
    each = every.join(per, [*KEYS, "table"], "left").join(may, [*KEYS, "table"], "left")
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    reason = F.when((n == 0) & F.col("may").isNull(), F.concat("table", F.lit(": empty"))).when(bad > 0, F.concat("table", F.lit(": "), bad.cast("string"), F.lit(" incomplete rows")))
    return each.groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", n.alias("n"))))).alias("counts"),
        F.array_sort(F.collect_list(F.when(n == 0, F.col("table")))).alias("missing"), F.array_sort(F.collect_list(reason)).alias("refused"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def ingest(spark: SparkSession, root: str, delivered: dict[str, DataFrame], sessions: DataFrame, allowed: DataFrame, required: dict[str, tuple[str, ...]] | None = None, batch: str | None = None, at: Column | None = None, after: Step = lambda step: None) -> DataFrame:
    """Takes what is pending; returns year, round, session, counts, missing, refused of the sessions it looked at.

    delivered: tables by name, each with the keys year, round, session. allowed: (year, round, session, table) that may be
    empty. required: by table, columns that may not be null. batch: a name of the run; a run that is repeated under the
    same name replaces its ledger rows. after(step) is called after each of "staged", "validated", "written", "marked".
    """
    todo = written(pending(sessions, ledger(spark, root)))
    if todo.isEmpty():
        return todo.select(*KEYS, F.create_map().cast("map<string, bigint>").alias("counts"), F.array().cast("array<string>").alias("missing"), F.array().cast("array<string>").alias("refused"))
    # what is validated is what is written, whatever arrives meanwhile
    staged = {name: written(rows.join(todo, list(KEYS), "left_semi")) for name, rows in delivered.items()}
    after("staged")
    found = written(verdicts(todo, staged, allowed, required or {}))
    good = found.filter(F.size("refused") == 0)
    after("validated")
    for name, rows in staged.items():
        rows.join(good, list(KEYS), "left_semi").repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{root}/{name}")
    after("written")
    if not good.isEmpty():
        marked = good.select(*KEYS, "counts", "missing", (F.current_timestamp() if at is None else at).cast("timestamp").alias("ingested_at"), F.lit(batch or uuid.uuid4().hex).alias("batch"))
        marked.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/_ledger")
    after("marked")
    discard(todo, *staged.values())
    return found


def ingest_announced(spark: SparkSession, root: str, announcements: str, delivered: Callable[[], dict[str, DataFrame]], allowed: DataFrame, checkpoint: str, required: dict[str, tuple[str, ...]] | None = None, after: Step = lambda step: None) -> int:
    """Reads new files of announcements (year, round, session) as a stream and takes what they announce; returns how many
    sessions were done by this run.

    Each batch first adds its announcements to those kept below the root, under the number of the batch, so one that
    is repeated after a crash adds nothing twice. Then all that is announced and not done is tried, what an earlier run
    refused too. delivered() gives the tables as they are when a batch begins.
    """
    before = ledger(spark, root).count()

    def take(rows: DataFrame, number: int) -> None:
        kept = rows.select(*KEYS).distinct().withColumn("batch", F.lit(number))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/_announced")
        again()

    def again() -> None:
        if _exists(spark, f"{root}/_announced"):
            ingest(spark, root, delivered(), spark.read.parquet(f"{root}/_announced"), allowed, required, after=after)

    stream = spark.readStream.schema("year INT, round INT, session STRING").parquet(announcements)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    again()  # without new announcements there was no batch
    return ledger(spark, root).count() - before
