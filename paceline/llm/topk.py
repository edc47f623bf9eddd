"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks: a block of queries goes to all tasks, which multiply it with
batches of rows. No pass keeps scores. The first pass gives each query's range of scores; each further pass counts
the scores of the current range in `bins` equal bins, Spark sums those counts over the tasks, and the bin in which
the k-th highest score lies is the next range, until that is one value, the k-th highest, or there are no more than k
candidates. A last pass keeps what reaches that value: each task at most its own k best for a query, ties to the
smaller id, which holds all that can be among the k best of all tasks. A window then ranks them.

Blocks are dealt by a hash of the id so that a block holds about block_size queries; block_size * bins bounds what
the driver and the broadcasts hold. Each block's answers are written before the next block, so the plan doesn't grow.

Scores are exact at any size of the components: doubles hold whole numbers up to 2^53, 64-bit integers the next, and
Python's integers the rest. A score that does not fit the result's 64 bits is an error, not a wrong number.

Defined cases: rows with a null id, a null vector, or null or non-finite components take no part; a query meets only
vectors of its own length; rows with the query's id count as its own; of repeated query rows one is asked; a query
with fewer than k candidates returns all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.shared import cut, cut_parts, drop

SCALE = 1024
ROUNDS: list[int] = []  # after each pass of histograms, how many queries' k-th values are still to be found


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole components floor(scale * x), as doubles, of rows that can take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: whole(e * scale)).alias("v"))


def whole(x: Column) -> Column:
    """The floor as a double; those from 2^53 are whole, and beyond 2^63 floor() would give other numbers."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def products(block: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The inner products of whole numbers in doubles, as 64-bit integers."""
    bound = float(np.abs(block).max(initial=0)) * float(np.abs(m).max(initial=0)) * m.shape[1]
    if bound < 2.0**53:
        return (block @ m.T).astype(np.int64)
    if bound < 2.0**62:
        return block.astype(np.int64) @ m.T.astype(np.int64)
    large = np.array([[int(x) for x in r] for r in block], object) @ np.array([[int(x) for x in r] for r in m], object).T
    if any(not -(2**63) <= x < 2**63 for x in large.ravel()):
        raise OverflowError("a score does not fit in 64 bits")
    return large.astype(np.int64)


def _scores(frames: Iterator[pd.DataFrame], ids: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each batch: its ids, the scores (queries x rows) and what counts of them."""
    for frame in frames:
        frame = frame[[len(v) == block.shape[1] for v in frame["v"]]]
        for start in range(0, len(frame), 2048):
            part = frame.iloc[start : start + 2048]
            got = part["vec_id"].to_numpy()
            yield got, products(block, np.stack(part["v"].to_numpy())), ids[:, None] != got[None, :]


def apart(s: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How far s is above lo, which may be more than a signed number holds."""
    return s.astype(np.uint64) - lo.astype(np.uint64)


def _block(rows: DataFrame, ids: np.ndarray, block: np.ndarray, k: int, bins: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    queries = sc.broadcast((ids, block))

    def ranges(frames):
        ids, block = queries.value
        lo, hi, n = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).min), np.zeros(len(ids), np.int64)
        for _, s, ok in _scores(frames, ids, block):
            lo = np.minimum(lo, np.where(ok, s, np.iinfo(np.int64).max).min(axis=1))
            hi = np.maximum(hi, np.where(ok, s, np.iinfo(np.int64).min).max(axis=1))
            n += ok.sum(axis=1)
        keep = n > 0
        yield pd.DataFrame({"q": np.arange(len(ids))[keep], "lo": lo[keep], "hi": hi[keep], "n": n[keep]})

    found = rows.mapInPandas(ranges, "q long, lo long, hi long, n long").groupBy("q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas()
    lo, hi = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
    above, inside = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    q = found["q"].to_numpy()
    lo[q], hi[q], inside[q] = found["lo"], found["hi"], found["n"]
    active = (hi > lo) & (inside > k)
    while active.any():
        width = apart(hi, lo) // np.uint64(bins) + np.uint64(1)
        state = sc.broadcast((lo.copy(), hi.copy(), width, active.copy()))

        def counts(frames, state=state):
            ids, block = queries.value
            lo, hi, width, active = state.value
            at = np.flatnonzero(active)
            total = np.zeros((len(at), bins), np.int64)
            for _, s, ok in _scores(frames, ids[at], block[at]):
                ok &= (s >= lo[at, None]) & (s <= hi[at, None])
                b = (apart(s, lo[at, None]) // width[at, None]).astype(np.int64) + np.arange(len(at))[:, None] * bins
                total += np.bincount(b[ok], minlength=total.size).reshape(total.shape)
            i, b = np.nonzero(total)
            yield pd.DataFrame({"q": at[i], "b": b, "n": total[i, b]})

        hist = rows.mapInPandas(counts, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wanted = rows.sparkSession.createDataFrame(pd.DataFrame({"q": np.flatnonzero(active), "want": (k - above)[active]}))
        hist = hist.withColumn("c", F.sum("n").over(down)).join(F.broadcast(wanted), "q")  # a row for each query of the block
        hit = hist.filter((F.col("c") >= F.col("want")) & (F.col("c") - F.col("n") < F.col("want"))).toPandas()
        at = hit["q"].to_numpy()
        first = lo[at].astype(np.uint64) + hit["b"].to_numpy().astype(np.uint64) * width[at]
        last = np.minimum(apart(hi[at], lo[at]), (hit["b"].to_numpy().astype(np.uint64) + np.uint64(1)) * width[at] - np.uint64(1))
        hi[at] = (lo[at].astype(np.uint64) + last).astype(np.int64)
        lo[at] = first.astype(np.int64)
        above[at] += (hit["c"] - hit["n"]).to_numpy()
        inside[at] = hit["n"].to_numpy()
        active = (hi > lo) & (above + inside > k)
        ROUNDS.append(int(active.sum()))
    floor = sc.broadcast(lo)

    def best(frames):
        ids, block = queries.value
        least = floor.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        for got, s, ok in _scores(frames, ids, block):
            ok &= s >= least[:, None]
            for i in np.flatnonzero(ok.any(axis=1)):
                v, x = np.concatenate([held[i][0], got[ok[i]]]), np.concatenate([held[i][1], s[i][ok[i]]])
                first = np.lexsort((v, -x))[:k]
                held[i] = v[first], x[first]
        n = [len(v) for v, _ in held]
        yield pd.DataFrame({"query_id": np.repeat(ids, n), "vec_id": np.concatenate([v for v, _ in held]), "score": np.concatenate([x for _, x in held])})

    return rows.mapInPandas(best, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block_size: int = 1024, bins: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the highest inner product, for each vec_id divisible by every."""
    ROUNDS.clear()
    rows = cut(quantised(vectors))
    asked = cut(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]))
    n_blocks = max(1, -(-asked.count() // block_size))

    def answers() -> Iterator[DataFrame]:
        for b in range(n_blocks):
            got = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toPandas().sort_values("vec_id")
            for length in sorted({len(v) for v in got["v"]}):
                same = got[[len(v) == length for v in got["v"]]]
                block = np.array([list(v) for v in same["v"]], np.float64).reshape(len(same), length)
                yield _block(rows, same["vec_id"].to_numpy(np.int64), block, k, bins)

    parts = cut_parts(rows.sparkSession, answers(), "query_id long, vec_id long, score long")
    drop(rows, asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
