"""Line dedup by a suffix array over line-id sequences, built by distributed prefix doubling.

A line's id is its 128-bit hash. Suffixes are sorted by their first 2^k lines for k = 0, 1, 2, ...: the rank of a
suffix at one level is the place of the pair of its halves' ranks at the level before in their sorted order. Suffixes
whose first 2^k lines occur once leave, since nothing longer that starts there can repeat.

Longest-common-prefix intervals. The suffixes that share their first m lines form an interval of depth m at least.
With 2^k the greatest power of two up to m, it is known by m and two ranks of level k: that of the suffix, and that of
the suffix m - 2^k lines further on, whose 2^k lines end where the m lines end. So intervals of any depth come from one
grouping, and their first place says which suffixes have an earlier copy.

What is deleted. A line goes if it lies in a repeated run of lines that has `least_words` words or more and of which
an earlier copy exists: in a document of a smaller id, or further up in the same one. Runs count in their whole length,
so these are the maximal runs. The first copy of each stays, and so do short lines that repeat alone. Not all depths
have to be looked at. In a run, each line lies in the shortest run of enough words that starts where the whole run
starts; or, if that ends before the line, in the shortest run of enough words that ends with the line. Both repeat as
parts of the whole. So the intervals asked for are, for each line, those of the shortest runs of enough words that
start and that end there, and doubling stops at the deepest of them.

No group is gathered: an interval is known by a count and its first place, with partial sums, and rows meet that by a
join, which Spark splits where it is skewed. A task holds the lines of one document at a time.

Defined cases: null texts stay null and have no lines; empty texts have one empty line; rows with null ids come last,
repeated ids in the order of the rows as first written; an empty table gives an empty result; the text column is
replaced, and so are columns named like the added ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paceline.llm.shared import aside, cut, drop, restored, with_python

ROWS = 100_000


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the lines of the shortest run of `least` words that starts there and that ends there; 0 if none."""
    n, total = len(words), np.r_[0, np.cumsum(words)]
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    return np.where(end <= n, np.maximum(end - at, 1), 0), np.where(start >= 0, np.maximum(at + 1 - start, 1), 0)


def lines_of(held: DataFrame, text: str, key: str, least_words: int) -> DataFrame:
    """rid, key, pos, a, b (the line's hash), ahead, behind (see shortest_runs): the lines of all texts."""
    kind = held.schema[key].dataType
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("key", kind), *T.StructType.fromDDL("pos int, a long, b long, ahead int, behind int").fields])
    names, most = schema.names, ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, pos, hashes, ahead, behind = [], [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                    hashes.append(b"".join(blake2b(x, digest_size=16).digest() for x in lines))
                    shortest = shortest_runs(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), least_words)
                    row.append(np.full(len(lines), i))
                    pos.append(np.arange(len(lines), dtype=np.int32))
                    ahead.append(shortest[0].astype(np.int32))
                    behind.append(shortest[1].astype(np.int32))
                if row:
                    own = pa.array(np.concatenate(row))
                    ab = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    columns = [part.column(0).take(own), part.column(1).take(own), *map(pa.array, (np.concatenate(pos), ab[:, 0].copy(), ab[:, 1].copy(), np.concatenate(ahead), np.concatenate(behind)))]
                    out = pa.RecordBatch.from_arrays(columns, names=names)
                    for k in range(0, out.num_rows, most):
                        yield out.slice(k, most)

    return held.filter(F.col(text).isNotNull()).select("rid", key, text).mapInArrow(run, schema)


def whole_documents(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows, if there are, that end where a document (rid) ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        rid = table["rid"].to_numpy()
        end = int(np.searchsorted(rid, rid[-1]))  # rows are sorted by rid
        if end:
            yield table.slice(0, end)
        held = table.slice(end).combine_chunks().to_batches()
        size -= end
    if size:
        yield pa.Table.from_batches(held)


def stepped(ranked: DataFrame, n: int) -> DataFrame:
    """From (rid, key, pos, rank, ahead, behind) of runs of n lines, behind being that of the run's last line: runs of 2n
    lines as pairs of ranks, and, with their depth m, the runs asked for of n to 2n - 1 lines, as the ranks of their
    first and last n lines."""
    kind = ranked.schema["key"].dataType
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("key", kind), *T.StructType.fromDDL("pos int, a long, b long, ahead int, behind int, m int").fields])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    most = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches, most):
            rid, pos, rank, ahead, behind = (table[c].to_numpy() for c in ("rid", "pos", "rank", "ahead", "behind"))
            place = (np.cumsum(np.r_[0, rid[1:] != rid[:-1]]) << 32) + pos

            def at(rows: np.ndarray, lines: np.ndarray | int) -> np.ndarray:
                """Which row stands so many lines behind each of the rows; -1 if none does."""
                wanted = place[rows] + lines
                found = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
                return np.where((place[found] == wanted) & (pos[rows] + lines >= 0), found, -1)

            every = np.arange(len(place))
            asked = every[(ahead >= n) & (ahead < 2 * n)]
            parts = [(every, at(every, n), None), (asked, at(asked, ahead[asked].astype(np.int64) - n), ahead[asked])]
            asked = every[(behind >= n) & (behind < 2 * n)]
            first = at(asked, n - behind[asked].astype(np.int64))
            parts.append((first[first >= 0], asked[first >= 0], behind[asked][first >= 0]))
            for first, last, m in parts:
                ok = last >= 0
                one, two = first[ok], last[ok]
                key = table["key"].take(pa.array(one)).combine_chunks()
                depth = pa.nulls(len(one), pa.int32()) if m is None else pa.array(m[ok])
                columns = [pa.array(rid[one]), key, *map(pa.array, (pos[one], rank[one], rank[two], ahead[one], behind[two])), depth]
                yield from pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, arrow, strict=True)], names=schema.names).to_batches(max_chunksize=most)

    return ranked.repartition("rid").sortWithinPartitions("rid", "pos").mapInArrow(run, schema)


def repeated(runs: DataFrame) -> DataFrame:
    """(rid, pos, n): runs of n lines from pos, of those asked for, that have an earlier copy. runs: what lines_of gives."""
    order = F.struct(F.col("key").isNull().alias("last"), "key", "rid", "pos")
    found, n, before = None, 1, None
    while True:
        classes = runs.groupBy("a", "b").agg(F.count("*").alias("times")).filter("times > 1")
        # places in the sorted order of the pairs: increasing, not gapless
        ranks = cut(classes.select("a", "b").orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()))
        step = cut(stepped(runs.join(ranks, ["a", "b"]).select("rid", "key", "pos", "rank", "ahead", "behind"), n))
        drop(ranks)
        asked = step.filter(F.col("m").isNotNull())
        first = asked.groupBy("m", "a", "b").agg(F.count("*").alias("times"), F.min(order).alias("first")).filter("times > 1").drop("times")
        later = cut(asked.join(first, ["m", "a", "b"]).filter(order > F.col("first")).select("rid", "pos", F.col("m").alias("n")).distinct())
        found = later if found is None else found.unionByName(later)
        if before is not None:
            drop(before)
        n, before = 2 * n, step
        runs = step.filter(F.col("m").isNull()).drop("m")
        if runs.filter((F.col("ahead") >= n) | (F.col("behind") >= n)).isEmpty():
            drop(before)
            return found


def dedup(docs: DataFrame, least_words: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with text less the deleted lines, n_lines and n_removed (lines)."""
    held, names = aside(docs)
    held = cut(held.withColumn("rid", F.monotonically_increasing_id()))
    lines = cut(lines_of(held, names[text], names[key], least_words))
    spans = cut(repeated(lines).groupBy("rid").agg(F.collect_list(F.struct("pos", "n")).alias("spans")))
    drop(lines)

    def start():
        def work(texts: list, spans: list) -> list:
            out: list[list] = [[], [], []]
            for t, s in zip(texts, spans, strict=True):
                kept = lines = t.split("\n") if t is not None else []
                if s:
                    gone = bytearray(len(lines))
                    for x in s:
                        gone[x["pos"] : x["pos"] + x["n"]] = b"\1" * x["n"]
                    kept = [line for line, g in zip(lines, gone, strict=True) if not g]
                for column, x in zip(out, ("\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept)), strict=True):
                    column.append(x)
            return out

        return work

    # the texts move at every size: a plan that sent the spans of small inputs to all tasks would not tell of large ones
    out = with_python(held.join(spans.hint("merge"), "rid", "left"), [names[text], "spans"], "left_text string, n_lines long, n_removed long", start)
    return restored(out, names, n_lines=F.col("n_lines"), n_removed=F.col("n_removed"), **{text: F.col("left_text")}).select(
        *dict.fromkeys([*docs.columns, "n_lines", "n_removed"])
    )
