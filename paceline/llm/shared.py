"""Helpers that the corpus operators share: words, safe column names, cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of characters other than blank, tab, newline, VT, FF and CR.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a local one only where that is unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="paceline-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Bytes of a batch that goes to Python: long texts would make very large ones of Spark's usual 10,000 rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside run with batches of BATCH bytes; the session's own setting is back afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't recompute it, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: str) -> DataFrame:
    """One table of all parts, each written before the next is asked for."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    with small_batches(spark):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote. Only for those of which nothing that is still to be computed reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, marked for broadcast if it has few rows; Spark chooses the join for others."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def word_count(text: Column) -> Column:
    """Words of the text as long, 0 for null: each word with the spaces behind it shrinks to one character."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACES}]+", "")
    return F.length(F.regexp_replace(trimmed, rf"[^{SPACES}]++[{SPACES}]*+", "x")).cast("long")


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns to in_0, in_1, ... so that an operator's own columns can't clash with them.

    Returns the frame and {old name: new name}. Unlike packing into a struct this keeps column pruning.
    """
    names = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], **added: Column) -> DataFrame:
    """The columns set aside by aside(), under their own names, and the added ones, which win over equal names."""
    taken = {a.lower() for a in added}
    kept = [F.col(new).alias(old) for old, new in names.items() if old.lower() not in taken]
    return df.select(*kept, *(c.alias(a) for a, c in added.items()))


def with_python(df: DataFrame, needs: list[str], added: str, start: Callable[[], Callable[..., list]], rows: int = 256) -> DataFrame:
    """df with the columns `added` (a DDL string), computed from the columns `needs` in Arrow batches of a few rows.

    start() runs once in each task and returns the function from lists of values to lists of values. All other
    columns pass through as Arrow, untouched.
    """
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *new.fields])
    arrow = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = work(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in needs))
                arrays = [pa.array(x, type=t) for x, t in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)

    return df.mapInArrow(run, schema)
