"""Quality rules with n-gram perplexity.

Base rules are statistics of a text's words and lines. The language model is a modified Kneser-Ney model over
n-grams of characters (UTF-16 units, so no letter shares a symbol with another), one per language, of order 4 at most:
tasks count n-grams of whole texts, Spark sums the counts and derives from them
continuation counts, discounts, context weights and interpolated probabilities, order by order, from all n-grams.
After that, an n-gram of any order that a single document holds is left out, or a document's own oddities would make
it look ordinary: its count goes to the weight of its context, so probabilities still sum to 1.

Scoring is a join. Tasks cut their documents into chunks of CHUNK characters and list each chunk's distinct n-grams;
these meet the model in Spark, and each chunk's documents meet the probabilities of the chunk's own n-grams, sorted.
All documents are in the model, so none of their n-grams is missing there. A document's surprise is its log
perplexity per word. A language's band is its median plus and minus `spread` robust standard deviations, which widen
for short documents as the error of a mean of few words does; documents outside are rejected.

Documents are read twice, to count and to score, and chunks are numbered by the partition and place of their rows. Both
reads deal files into partitions by the settings and cores that the first one found, so executors that are lost or gained
between them change no chunk.

Size: the order is the same at every size, and no task, nor the driver, holds the model; a task holds one chunk, or
one text if that is longer.

Defined cases: null texts have no words and, like texts shorter than the order, no perplexity, which no band rejects;
documents with a null language form a group of their own; a language without any scored document has no band; an
empty table gives an empty result; columns named like the added ones are replaced; repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.shared import aside, cut, drop, restored, small

BITS = 16
MANY = -1
CHUNK = 16_000_000
SLICE = 1_000_000
UNMERGED = 500_000  # n-grams that a task gathers before it sums equal ones
SYMBOLS = "#*$%&|<>"


def codes(text: str, order: int) -> Iterator[np.ndarray]:
    """The packed n-grams of the whole text, in slices. Symbols are UTF-16 units: none is folded, and four fill 64 bits."""
    units = np.frombuffer(f"\n{text}".encode("utf-16-le", "surrogatepass"), np.uint16)
    for at in range(0, len(units) - order + 1, SLICE):
        s = units[at : at + SLICE + order - 1].astype(np.int64)
        n = len(s) - order + 1
        out = s[:n].copy()
        for k in range(1, order):
            out <<= BITS
            out |= s[k : n + k]
        yield out


def distinct(text: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the text, sorted, and their counts."""
    parts = [np.unique(c, return_counts=True) for c in codes(text, order)]
    if len(parts) == 1:
        return parts[0]
    return summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1))) if parts else (np.empty(0, np.int64),) * 2


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def merged(keys: np.ndarray, n: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, their summed counts, and the one document that holds each, or MANY."""
    order = np.argsort(keys, kind="stable")
    keys, n, holder = keys[order], n[order], holder[order]
    if not len(keys):
        return keys, n, holder
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    low, high = np.minimum.reduceat(holder, first), np.maximum.reduceat(holder, first)
    return keys[first], np.add.reduceat(n, first), np.where(low == high, low, MANY)


def chunk_of(at: int, chars: int, length: int, most: int) -> tuple[int, int]:
    """The chunk behind a document of this length and the characters in it so far: chunks end after `most` characters."""
    chars += length + 1
    return (at + 1, 0) if chars >= most else (at, chars)


def counted(docs: DataFrame, order: int, text: str, lang: str) -> DataFrame:
    """chunk, lang, code, n (occurrences) and holder: the distinct n-grams of each chunk of documents."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64()), ("holder", pa.int64())])
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = row = TaskContext.get().partitionId() << 32
        chars = size = 0
        held: dict[str | None, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k in list(held):
                keys, n, holder = merged(*(np.concatenate(x) for x in zip(*held.pop(k), strict=True)))
                for i in range(0, len(keys), 200_000):
                    part = slice(i, i + 200_000)
                    m = len(keys[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, at)), pa.array([k] * m, pa.string()), *map(pa.array, (keys[part], n[part], holder[part]))], schema=schema)

        for part in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            for t, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if t is not None:
                    keys, n = distinct(t, order)
                    held.setdefault(k, []).append((keys, n, np.full(len(keys), row)))
                    size += len(keys)
                    if size > UNMERGED:
                        held = {k: [merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for k, parts in held.items()}
                        size = 0
                row += 1
                behind, chars = chunk_of(at, chars, len(t or ""), most)
                if behind != at:
                    yield from out()
                    at, size = behind, 0
        yield from out()

    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("k"))
    return rows.mapInArrow(run, "chunk long, lang string, code long, n long, holder long")


def holder_of() -> Column:
    return F.when(F.min("holder") == F.max("holder"), F.min("holder")).otherwise(F.lit(MANY)).alias("holder")


def totals(parts: DataFrame) -> DataFrame:
    """lang, code, n and holder, for all n-grams of all texts."""
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"), holder_of())


def model(top: DataFrame, order: int, drops: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (lang, code, n, holder) of the highest order to (lang, k, code, logp) and (lang, k, code, logg), and the
    first's rows of the highest order, as (lang, code, p). If it drops the tables of lower orders, only that is left.

    The second holds contexts of k symbols and the weight with which they pass on to order k. Counts, discounts and
    continuation counts are those of all n-grams. One that a single document holds passes its whole count on.
    """
    mask = [(1 << BITS * k) - 1 for k in range(order)]
    tables = {order: top.select("lang", "code", F.col("n").alias("c"), "holder")}
    for k in range(order - 1, 0, -1):
        tables[k] = cut(tables[k + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit(mask[k])).alias("code")).agg(F.count("*").alias("c"), holder_of()))
    below = tables[1].groupBy("lang").agg((F.lit(1.0) / (F.count("*") + 1)).alias("q"))
    probs, weights = [], []
    for k in range(1, order + 1):
        t = tables[k]
        n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def discount(i: int, y=y):
            d = F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i))
            return F.least(F.greatest(d, F.lit(0.1)), F.lit(i - 0.1))

        d = t.groupBy("lang").agg(*n).select(F.col("lang").alias("l"), *(discount(i).alias(f"d{i}") for i in range(1, 4)))
        t = t.join(small(d), F.col("lang").eqNullSafe(F.col("l"))).drop("l")  # a row for each language
        t = t.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        t = t.withColumn("d", F.when(F.col("holder") == MANY, F.col("d")).otherwise(F.col("c").cast("double")))
        t = t.withColumn("h", F.shiftrightunsigned("code", BITS))
        ctx = t.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g")).select(F.col("lang").alias("l"), F.col("h").alias("hh"), "total", "g")
        weights.append(ctx.select(F.col("l").alias("lang"), F.lit(k - 1).alias("k"), F.col("hh").alias("code"), F.log("g").cast("float").alias("logg")))
        t = t.join(ctx, F.col("lang").eqNullSafe(F.col("l")) & (F.col("h") == F.col("hh"))).drop("l", "hh")
        if k == 1:
            t = t.join(small(below.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")))
        else:
            lower = below.select(F.col("lang").alias("l"), F.col("code").alias("s"), F.col("p").alias("q"))
            t = t.join(lower, F.col("lang").eqNullSafe(F.col("l")) & (F.col("code").bitwiseAND(F.lit(mask[k - 1])) == F.col("s")))
        t = t.select("lang", "code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("q")).alias("p"))
        below, older = cut(t), below
        if drops and k < order:
            drop(tables[k])
        if drops and k > 1:
            drop(older)
        probs.append(below.select("lang", F.lit(k).alias("k"), "code", F.log("p").cast("float").alias("logp")))
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return union(probs), union(weights), below


class Arrays:
    """A model's sorted arrays: {(lang, k): (codes, logs)} of n-grams and of contexts."""

    def __init__(self, order: int, probs: dict, weights: dict):
        self.order, self.probs, self.weights = order, probs, weights

    @staticmethod
    def look(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None:
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at].astype(np.float64)

    def surprise(self, text: str, lang: str | None) -> float | None:
        """The sum of the negative log probabilities of the text's n-grams."""
        keys, n = distinct(text, self.order)
        if not len(keys) or (lang, 1) not in self.probs:
            return None
        logs, left = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, 0, -1):
            own = keys[left] & ((1 << BITS * k) - 1) if k < self.order else keys[left]
            found, p = self.look(self.probs.get((lang, k)), own)
            logs[left[found]] += p[found]
            left, own = left[~found], own[~found]
            if not len(left):
                break
            known, g = self.look(self.weights.get((lang, k - 1)), (own.view(np.uint64) >> np.uint64(BITS)).view(np.int64))
            logs[left[known]] += g[known]
        logs[left] -= np.log(len(self.probs[lang, 1][0]) + 1)  # a symbol never seen
        return float(-(logs * n).sum())


def gathered(parts: DataFrame, value: str) -> dict:
    """{(lang, k): (sorted codes, values)}; the caller has checked the rows."""
    found = parts.toArrow()
    codes_, values = found["code"].to_numpy(), found[value].to_numpy()
    langs, kinds = found["lang"].combine_chunks().dictionary_encode(), found["k"].to_numpy()
    names = langs.dictionary.to_pylist()
    lang = langs.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    out = {}
    for i, name in enumerate([*names, None]):
        for k in np.unique(kinds[lang == i]):
            at = np.flatnonzero((lang == i) & (kinds == k))
            at = at[np.argsort(codes_[at])]
            out[name, int(k)] = codes_[at], values[at].astype(np.float32)
    return out


def fit(docs: DataFrame, order: int = 4, text: str = "text", lang: str = "lang") -> Arrays | None:
    """A model in the driver's memory of the n-grams that at least two documents hold: for small tables, and for texts
    outside them. `rules` has no such arrays."""
    top = cut(totals(counted(docs, order, text, lang)).filter(F.col("holder") == MANY))
    if top.isEmpty():
        return None
    probs, weights, _ = model(top, order)
    return Arrays(order, gathered(probs, "logp"), gathered(weights, "logg"))


#: What Spark deals files and rows into partitions by.
SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionNum", "spark.sql.leafNodeDefaultParallelism")


def same_splits(spark: SparkSession) -> Callable[[], AbstractContextManager]:
    """A context in which a scan gives the partitions that it gives now, though executors come or go meanwhile, or settings
    change: without it their number follows from the cores that are there when a job starts."""
    now = {k: spark.conf.get(k, None) for k in SPLITS}
    now[SPLITS[-1]] = now[SPLITS[-1]] or str(spark.sparkContext.defaultParallelism)
    now[SPLITS[2]] = now[SPLITS[2]] or now[SPLITS[-1]]

    @contextmanager
    def held() -> Iterator[None]:
        before = {k: spark.conf.get(k, None) for k in SPLITS}
        put = lambda k, v: spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for k, v in now.items():
            put(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                put(k, v)

    return held


def packed(held: DataFrame, text: str) -> DataFrame:
    """chunk, rows: the documents of each chunk of `counted`, all columns, as one compressed Arrow stream."""
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chars = TaskContext.get().partitionId() << 32, 0
        parts: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if parts:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
                    for part in parts:
                        writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])
                parts.clear()

        for batch in batches:
            start = 0
            for i, length in enumerate(pc.utf8_length(batch.column(batch.schema.get_field_index(text))).to_pylist()):
                behind, chars = chunk_of(at, chars, length or 0, most)
                if behind != at:
                    parts.append(batch.slice(start, i + 1 - start))
                    yield from out()
                    at, start = behind, i + 1
            if start < batch.num_rows:
                parts.append(batch.slice(start))
        yield from out()

    return held.mapInArrow(run, "chunk long, rows binary")


def scored_by(held: DataFrame, order: int, text: str, lang: str, kept: list[str]) -> DataFrame:
    """The columns `kept` of held with the five statistics and the surprise of a word, written.

    Each chunk's distinct n-grams meet the model in a join, and the chunk's documents meet their answers. Documents
    are read twice and must come in the same order, so anything but a scan of files or rows is written first.
    """
    if not 1 <= order <= 4:
        raise ValueError("n-grams of 1 to 4 symbols fit in 64 bits")
    if "Exchange" in held._jdf.queryExecution().executedPlan().toString():
        held = cut(held)
    as_first_read = same_splits(held.sparkSession)
    with as_first_read():
        parts = cut(counted(held, order, text, lang))
    top = cut(totals(parts))
    p = model(top, order, drops=True)[2]
    drop(top)
    known = p.select(F.col("lang").alias("l"), F.col("code").alias("c"), F.log("p").cast("float").alias("logp"))
    answers = parts.select("chunk", "lang", "code").join(known, F.col("lang").eqNullSafe(F.col("l")) & (F.col("code") == F.col("c")))
    schema = T.StructType([*(held.schema[c] for c in kept), *T.StructType.fromDDL(", ".join(f"{c} long" for c in COLUMNS) + ", surprise double").fields])

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            raise ValueError("documents came in another order when they were read again")
        langs, keys, logs = found["lang"].combine_chunks().dictionary_encode(), found["code"].to_numpy(), found["logp"].to_numpy()
        names = [*langs.dictionary.to_pylist(), None]
        lang_of = langs.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        tables = {}
        for i in np.unique(lang_of):
            at = np.flatnonzero(lang_of == i)
            at = at[np.argsort(keys[at])]
            tables[names[i]] = keys[at], logs[at].astype(np.float64)

        def surprise(t: str | None, k: str | None, words: int) -> float | None:
            own, n = distinct(t, order) if t and words else ((), ())
            if not len(own):
                return None
            table = tables.get(k, (np.zeros(1, np.int64) - 1, np.zeros(1)))
            at = np.minimum(np.searchsorted(table[0], own), len(table[0]) - 1)
            if (table[0][at] != own).any():
                raise ValueError("documents came in another order when they were read again")
            return float(-(table[1][at] * n).sum()) / words

        out = []
        for blob in docs["rows"]:
            for whole in pa.ipc.open_stream(blob.as_buffer()):
                for i in range(0, whole.num_rows, 256):
                    batch = whole.slice(i, 256)
                    texts, langs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, lang))
                    stats = [base_stats(t or "") for t in texts]
                    lost = [surprise(t, k, s[0]) for t, k, s in zip(texts, langs, stats, strict=True)]
                    added = [*(pa.array(x, pa.int64()) for x in zip(*stats, strict=True)), pa.array(lost, pa.float64())]
                    out.append(pa.RecordBatch.from_arrays([*batch.select(kept).columns, *added], names=schema.names))
        return pa.Table.from_batches(out)

    with as_first_read():
        out = cut(packed(held, text).groupBy("chunk").cogroup(answers.select("chunk", "lang", "code", "logp").groupBy("chunk")).applyInArrow(score, schema))
    drop(parts, p)
    return out


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; see op4's contract."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six spaces
    n_symbols = sum(map(text.count, SYMBOLS))
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(" \t\v\f\r"))
            else:
                seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) < len(windows):
        once: set[tuple] = set()
        twice: set[tuple] = set()
        for w in windows:
            (twice if w in once else once).add(w)
        end = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeat += i + 5 - max(end, i)
                end = i + 5
    return len(words), word_chars, n_symbols, dup, repeat


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules(docs: DataFrame, spread: float = 6.0, order: int = 4, text: str = "text", lang: str = "lang", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs, or these columns of them, with the five statistics, base_failed, surprise (log perplexity of a
    word), its band low and high, and kept."""
    columns = tuple(docs.columns) if columns is None else columns
    held, names = aside(docs.select(*dict.fromkeys([*columns, text, lang])))
    held = held.withColumn("k", F.col(names[lang]).cast("string"))
    own = {c: names[c] for c in columns}
    scored = scored_by(held, order, names[text], "k", [*own.values(), "k"])
    scored = scored.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = scored.join(small(banded(scored)), F.col("k").eqNullSafe(F.col("l")), "left")
    width = spread * F.sqrt(F.col("far") ** 2 + F.col("per_word") ** 2 / F.greatest("n_words", F.lit(1)))
    out = out.withColumn("low", F.col("mid") - width).withColumn("high", F.col("mid") + width)
    inside = F.coalesce(F.col("surprise").between(F.col("low"), F.col("high")), F.lit(True))
    added = {c: F.col(c) for c in (*COLUMNS, "base_failed", "surprise", "low", "high")}
    return restored(out, own, **added, kept=~F.col("base_failed") & inside)


def banded(scored: DataFrame, least: float = 0.02) -> DataFrame:
    """(l, mid, far, per_word) for each language, from the documents that pass the base rules: the median surprise,
    the robust deviation from it, and the robust deviation times the root of the words.

    Values are counted at four decimals first, so that a median is exact on them, the same in every run, and its state
    grows with the values that there are and not with the documents.
    """
    ok = scored.filter(~F.col("base_failed") & F.col("surprise").isNotNull())

    def median(rows: DataFrame, value: Column, name: str) -> DataFrame:
        counts = rows.groupBy("k", F.round(value, 4).alias("x")).agg(F.count("*").alias("n"))
        return counts.groupBy("k").agg(F.percentile("x", F.lit(0.5), F.col("n")).alias(name)).withColumnRenamed("k", "l")

    mid = cut(median(ok, F.col("surprise"), "mid"))
    off = ok.join(mid, F.col("k").eqNullSafe(F.col("l"))).drop("l").withColumn("off", F.abs(F.col("surprise") - F.col("mid")) * 1.4826)
    far, per_word = median(off, F.col("off"), "far"), median(off, F.col("off") * F.sqrt("n_words"), "per_word")
    same = lambda other: mid.l.eqNullSafe(other.l)
    return mid.join(far, same(far)).join(per_word, same(per_word)).select(mid.l, "mid", F.greatest("far", F.lit(least)).alias("far"), "per_word")
