"""Session files, ledgers and parameter files.

A raw table is a folder partitioned by year, round and session. Columns of a file are given as a DDL schema, so that
a missing optional column reads as null instead of being inferred.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("year", "round", "session")
LEDGER = "counts MAP<STRING, BIGINT>, missing ARRAY<STRING>, ingested_at STRING, _corrupt STRING"


def prepared(table: DataFrame, year: int, rnd: int, session: str, as_text: tuple[str, ...] = ()) -> DataFrame:
    """Adds the event's keys; columns of mixed types become text."""
    texts = {c: F.col(c).cast("string") for c in as_text}
    return table.withColumns(texts | {"year": F.lit(year), "round": F.lit(rnd), "session": F.lit(session)})


def write_sessions(table: DataFrame, path: str) -> None:
    """Replaces the partitions that table has rows for and leaves the others: a rerun of a session is harmless."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_sessions(spark: SparkSession, path: str, columns: str, session: str | None = None, required: bool = True) -> DataFrame:
    """The columns of all events, of one kind of session if named; partition filters prune files."""
    schema = T.StructType([*T.StructType.fromDDL(columns).fields, *T.StructType.fromDDL("year INT, round INT, session STRING").fields])
    out = spark.read.schema(schema).parquet(path)
    if session is not None:
        out = out.filter(F.col("session") == session)
    if required and out.isEmpty():
        raise FileNotFoundError(f"no rows of {session or 'any session'} in {path}")
    return out


def read_events(spark: SparkSession, path: str, columns: str, year: int, rnd: int, session: str) -> DataFrame:
    """One event's rows, none if it has no file."""
    out = read_sessions(spark, path, columns, session, required=False)
    return out.filter((F.col("year") == year) & (F.col("round") == rnd))


def no_nan(table: DataFrame) -> DataFrame:
    """NaN becomes null in all floating-point columns."""
    fixed = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in table.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return table.withColumns(fixed)


def seconds(nanoseconds: str):
    """A time span that Parquet holds as whole nanoseconds, in seconds."""
    return F.col(nanoseconds) / F.lit(1e9)


def write_marker(path: str, year: int, rnd: int, session: str, counts: dict[str, int], missing: list[str], at: str) -> None:
    """Marks a session as done, in whichever file system the path names. To be called last, so that an interrupted session
    is done again; the marker appears whole, by a rename."""
    spark = SparkSession.active()
    part, target = (spark._jvm.org.apache.hadoop.fs.Path(path, name) for name in (f".{year}_{rnd}_{session}.tmp", f"{year}_{rnd}_{session}.json"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(json.dumps({"counts": counts, "missing": missing, "ingested_at": at}).encode())
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """year, round, session, counts, missing of all markers; unreadable ones are flagged."""
    raw = spark.read.schema(LEDGER).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_(\d+)_(.+)\.json$", 0)
    part = lambda i: F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_(\d+)_(.+)\.json$", i)
    return raw.filter(name != "").select(
        part(1).cast("int").alias("year"), part(2).cast("int").alias("round"), part(3).alias("session"),
        "counts", "missing", F.col("_corrupt").isNotNull().alias("unreadable"),
    )


def unexpected_gaps(ledger: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tables that sessions lack and that aren't allowed (year, round, session, table) to be lacking."""
    gaps = ledger.select("year", "round", "session", F.explode("missing").alias("table"))
    return gaps.join(allowed, ["year", "round", "session", "table"], "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).option("header", True).csv(path)


def best_trial(log: DataFrame, metric: str, *by: str) -> DataFrame:
    """The trial with the highest metric, of equals the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(metric), "trial_id")
    return log.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def read_params(path: str) -> dict:
    """A small parameter file on the driver; absent means none."""
    file = Path(path)
    return json.loads(file.read_text()) if file.exists() else {}
