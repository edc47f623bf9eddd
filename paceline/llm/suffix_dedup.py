"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a `length`-byte string (a window) that also starts anywhere else goes. One suffix array over
the corpus would pass through one machine, so Spark first brings together what can be equal:

1. A window's anchor is its 16-byte gram with the least hash, the leftmost of equals: equal windows have equal
   anchors at equal offsets. Consecutive windows with one anchor form a run, cut in two where the anchor passes the
   middle of the window: each part's windows share the bytes of one half beside the anchor, its core. Runs whose
   anchor and core occur once in the corpus go, by a count with partial sums.
2. Runs of the same anchor, extent and 128-bit cryptographic fingerprint are equal: with two or more of them, all their
   windows repeat.
3. What is left are runs that overlap in part, at the edges of repeats. The bytes of one run of each kind are fetched
   and grouped by anchor and core. In a group, each run is cut to what it can share with another, by the longest
   agreement to the left and to the right of the anchor, and the suffix array of the rest is built: windows are equal
   where neighbours in it agree in their first `length` bytes. A group of more than MOST kinds, such as a passage that
   a third of all documents holds, needn't fit in a task: it is split as far as groups can be, to groups of one window,
   whose suffix array would be trivial, and these are counted in Spark.

The suffix array is built by linear grouping. Suffixes are grouped by their first byte and groups are taken from the
last to the first. For each suffix of the group its previous smaller pointer is the nearest suffix before it in a
lower group; those suffixes get the group's word appended to theirs, as often as they are pointed at, which splits
their groups. In the end suffixes are grouped by their longest Lyndon prefix, and one pass along the pointers emits
each group's order.

Rows are known by hashes of the id and of the text, so equal rows share a result.

Defined cases: null and short texts keep everything; an empty table gives an empty result; repeated rows count as
copies of one another; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import aside, cut, restored, with_python

GRAM = 16
SLICE = 1 << 22
MOST = 2000
POSITION = np.uint64((1 << 26) - 1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(t: list[int]) -> list[int]:
    """Starts of the suffixes of t in ascending order; t ends in its only least value."""
    n = len(t)
    sa = sorted(range(n), key=t.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n  # last: a group's last place, by its first place, which names it
    first = 0
    for r, i in enumerate(sa):
        if t[i] != t[sa[first]]:
            first = r
        place[i], group[i], last[first] = r, first, r
    prev = [-1] * n
    end = n - 1
    while end > 0:
        own = group[sa[end]]
        points: dict[int, int] = {}
        for i in sorted(sa[own : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= own:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for p, c in points.items():
            split.setdefault(group[p], {}).setdefault(c, []).append(p)
        for g, by_count in split.items():
            stop = last[g]
            for c in sorted(by_count, reverse=True):
                end_of_part = stop
                for p in by_count[c]:
                    q, at = sa[stop], place[p]
                    sa[at], sa[stop], place[q], place[p] = q, p, at, stop
                    stop -= 1
                for p in by_count[c]:
                    group[p] = stop + 1
                last[stop + 1] = end_of_part
            if stop >= g:
                last[g] = stop
        end = own - 1
    out, filled, done = [0] * n, {}, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            k = filled.get(g, g)
            out[k] = p
            filled[g] = k + 1
            done[p] = 1
            p = prev[p]
    return out


_random = np.random.default_rng(9)
BYTE = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * FACTOR
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> list[np.ndarray]:
    """FACTOR to the powers 0 to n, and its inverse likewise, modulo 2 to the 64."""
    if len(_powers[0]) <= n:
        for i, f in enumerate((int(FACTOR), pow(int(FACTOR), -1, 1 << 64))):
            steps = np.full(n + 1, f, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def sums(b: np.ndarray) -> np.ndarray:
    """Prefix sums from which hashed() gives the fingerprint of any part."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * powers(len(b))[0][: len(b)], out=out[1:])
    return out


def hashed(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of parts that bring together what may be equal; they decide nothing."""
    return _mixed((total[end] - total[start]) * _powers[1][start])


def digests(data: bytes, start: np.ndarray, end: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """Cryptographic 128-bit fingerprints of the parts with their extents, as two columns."""
    ends = extent.astype("<i8").tobytes()
    parts = (data[x:y] + ends[8 * i : 8 * i + 8] for i, (x, y) in enumerate(zip(start.tolist(), end.tolist(), strict=True)))
    return np.frombuffer(b"".join(blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def runs(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For the runs of windows with one anchor: first and last window, the anchor's place and hash."""
    n = len(b) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = BYTE[b]
    for k in (1, 2, 4, 8):  # grams of 2, 4, 8 and 16 bytes
        h = h[:-k] * powers(8)[0][k] + h[k:]
    h = _mixed(h)
    w = length - GRAM + 1
    packed = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    pad = -len(packed) % w
    blocks = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(down[:n], up[w - 1 : w - 1 + n]) & POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    at = anchor[first]
    return first, last, at, h[at]


def records(text: str | None, length: int, kinds: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor (with core), two halves of the kind (fingerprint with extent), first window and extent of each run of the
    text, in slices; without kinds only the anchors.

    An extent is 512 times the windows after the first, plus the anchor's distance from the first. Slices overlap by
    a window less a byte. A run cut in two at a slice's end is two runs; as the place of the cut is no part of the
    content, the caller's last step compares such runs by bytes like others.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    half = (length - GRAM) // 2
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        b = data[at : at + SLICE + length - 1]
        first, last, anchor, h = runs(b, length)
        if not len(first):
            continue
        total, raw = sums(b), b.tobytes()
        parts = []
        for side in (0, 1):  # the anchor at least half behind the window's start, then less
            lo = first if side == 0 else np.maximum(first, anchor - half + 1)
            hi = np.minimum(last, anchor - half) if side == 0 else last
            some = np.flatnonzero(lo <= hi)
            lo, hi, own = lo[some], hi[some], anchor[some]
            core = hashed(total, own - half, own) if side == 0 else hashed(total, own, own + length - half + 1)
            extent = (hi - lo) * 512 + own - lo
            key = _mixed(h[some] ^ (core * FACTOR + np.uint64(side)))
            if not kinds:
                parts.append((key.view(np.int64),))
                continue
            kind = digests(raw, lo, hi + length, extent)
            parts.append((key.view(np.int64), kind[:, 0], kind[:, 1], lo + at, extent))
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _found(docs: DataFrame, length: int, kinds: bool) -> DataFrame:
    """The records of (a, b, text); without kinds only anchors, with their number in a batch."""
    fields = [("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), ("kind", pa.int64()), ("kind2", pa.int64()), ("first", pa.int32()), ("extent", pa.int32())]
    schema = pa.schema(fields if kinds else [("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                a, b, texts = (batch.column(i).slice(at, 512).to_pylist() for i in range(3))
                parts = [(x, y, r) for x, y, t in zip(a, b, texts, strict=True) for r in records(t, length, kinds)]
                if not parts:
                    continue
                columns = [np.concatenate(c) for c in zip(*(r for _, _, r in parts), strict=True)]
                if kinds:
                    n = [len(r[0]) for _, _, r in parts]
                    ids = [np.repeat(np.array([p[i] for p in parts], np.int64), n) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*ids, *columns[:3])), *(pa.array(c.astype(np.int32)) for c in columns[3:])], schema=schema)
                else:
                    keys, n = np.unique(columns[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], schema=schema)

    ddl = "a long, b long, anchor long, kind long, kind2 long, first int, extent int" if kinds else "anchor long, n long"
    return docs.mapInArrow(run, ddl)


def repeats(contexts: list[tuple[bytes, bool]], length: int) -> list[np.ndarray]:
    """For each context, whether each of its windows is also elsewhere in these contexts, by a suffix array.

    Contexts that stand for one run only are marked True; the others' windows are known to repeat.
    """
    size = sum(len(c) + 1 for c, _ in contexts) + 1
    t = np.zeros(size, np.uint8)
    valid = np.zeros(size, bool)
    starts, at = [], 0
    for c, _ in contexts:
        starts.append(at)
        t[at : at + len(c)] = np.frombuffer(c, np.uint8)
        valid[at : at + len(c) - length + 1] = True
        at += len(c) + 1
    marks = t.astype(np.int16) + 2
    ends = np.array(starts) + [len(c) for c, _ in contexts]
    marks[ends] = 1
    marks[-1] = 0
    sa = np.array(suffix_array(marks.tolist()))
    sa = sa[valid[sa]]
    windows = np.lib.stride_tricks.sliding_window_view(t, length)
    again = np.zeros(size, bool)
    for k in range(0, len(sa) - 1, 4096):
        x, y = sa[k : k + 4096], sa[k + 1 : k + 4097]
        same = (windows[x[: len(y)]] == windows[y]).all(axis=1)
        again[x[: len(y)][same]] = True
        again[y[same]] = True
    return [again[s : s + len(c) - length + 1] for s, (c, _) in zip(starts, contexts, strict=True)]


def agreement(x: bytes, y: bytes) -> int:
    """How many bytes at their start are equal."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def trimmed(group: list[dict], length: int) -> list[dict]:
    """The rows of one anchor cut to windows that may be in another row, without those that have none."""
    reach = []
    for side in ("right", "left"):
        parts = [r["context"][r["left"] :] if side == "right" else r["context"][: r["left"]][::-1] for r in group]
        order = sorted(range(len(parts)), key=parts.__getitem__)
        best = [0] * len(parts)
        for i, j in zip(order, order[1:], strict=False):
            n = agreement(parts[i], parts[j])
            best[i], best[j] = max(best[i], n), max(best[j], n)
        reach.append(best)
    out = []
    for r, right, left in zip(group, *reach, strict=True):
        if left + right >= length:
            lo = r["left"] - left
            out.append(r | {"first": r["first"] + lo, "context": r["context"][lo : r["left"] + right]})
    return out if len(out) > 1 else []


def ranges(flags: np.ndarray, at: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(x) + at, int(y) - 1 + at) for x, y in zip(edge[::2], edge[1::2], strict=True)]


SPANS = "a long, b long, first int, last int"


def _by_suffixes(edges: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the single runs among edges, rows of one anchor standing together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                flags = repeats([(r["context"], r["n"] == 1) for r in held], length)
                got = [(r["a"], r["b"], x, y) for r, f in zip(held, flags, strict=True) if r["n"] == 1 for x, y in ranges(f, r["first"])]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)
            held.clear()

        group: list[dict] = []
        before = None
        for batch in batches:
            for r in batch.to_pylist():
                this = r["anchor"], r["a"], r["b"], r["first"]
                if this == before:
                    continue  # of an equal row that another task fetched
                before = this
                if group and r["anchor"] != group[0]["anchor"]:
                    held += trimmed(group, length)
                    group = []
                    if sum(len(x["context"]) for x in held) > 1 << 14:
                        yield from out()
                group.append(r)
        held += trimmed(group, length)
        yield from out()

    return edges.mapInArrow(run, SPANS)


def _by_windows(edges: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many kinds of runs, split down to single windows: of the fingerprints of these, 128
    bits each, Spark counts which there are twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("w", pa.int64()), ("w2", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                first = np.arange(len(r["context"]) - length + 1)
                w = digests(r["context"], first, first + length, np.zeros(len(first), np.int64))
                m = len(first)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(m, r[c])) for c in ("a", "b", "n")), pa.array((first + r["first"]).astype(np.int32)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], schema=schema)

    windows = edges.mapInArrow(run, "a long, b long, n long, at int, w long, w2 long")
    often = windows.groupBy("w", "w2").agg(F.count("*").alias("times")).filter("times > 1")
    return windows.filter("n = 1").join(often, ["w", "w2"], "left_semi").select("a", "b", F.col("at").alias("first"), F.col("at").alias("last"))


def contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs. Rows equal in (a, b) would all give the same: each task fetches them of one row only."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("first", pa.int32()), ("left", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                new = []
                for row in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    new.append(row not in seen)
                    seen.add(row)
                got = []
                for r in part.filter(pa.array(new, pa.bool_())).to_pylist():
                    data = r["text"].encode("utf-8", "surrogatepass")
                    got += [(r["a"], r["b"], x["anchor"], x["n"], x["kinds"], x["first"], x["extent"] & 511, data[x["first"] : x["first"] + (x["extent"] >> 9) + length]) for x in r["runs"]]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)

    fetched = texts.join(wanted, ["a", "b"]).select("a", "b", "text", "runs")
    return fetched.mapInArrow(run, "a long, b long, anchor long, n long, kinds long, first int, left int, context binary")


def dedup(docs: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans and kept (the bytes that are left)."""
    if not 2 * GRAM <= length <= 512:
        raise ValueError("length must be from 32 to 512")
    held, names = aside(docs)
    held = held.withColumn("a", F.xxhash64(names[key])).withColumn("b", F.xxhash64(names[text]))
    texts = held.select("a", "b", F.col(names[text]).cast("string").alias("text"))
    known = texts.filter(F.octet_length("text") >= length)

    anchors = _found(known, length, False).groupBy("anchor").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor")
    again = cut(_found(known, length, True).join(anchors, "anchor", "left_semi"))
    kinds = again.groupBy("anchor", "kind", "kind2").agg(F.count("*").alias("n"), F.min(F.struct("a", "b", "first", "extent")).alias("one"))
    kinds = cut(kinds.select("anchor", "kind", "kind2", "n", "one.*"))
    many = kinds.filter("n > 1").select("anchor", "kind", "kind2")
    last = F.col("first") + F.shiftright("extent", 9)
    whole = again.join(many, ["anchor", "kind", "kind2"], "left_semi").select("a", "b", "first", last.alias("last"))

    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    edges = kinds.join(groups.select("anchor", "kinds"), "anchor")
    wanted = edges.groupBy("a", "b").agg(F.collect_list(F.struct("anchor", "n", "kinds", "first", "extent")).alias("runs"))
    fetched = cut(contexts(texts, wanted, length))
    few = fetched.filter(F.col("kinds") <= MOST).repartition("anchor").sortWithinPartitions("anchor", "a", "b", "first")
    parts = _by_suffixes(few.select("anchor", "n", "a", "b", "first", "left", "context"), length)
    parts = parts.unionByName(_by_windows(fetched.filter(F.col("kinds") > MOST), length))
    spans = whole.unionByName(parts).groupBy("a", "b").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def start():
        def work(texts: list, spans: list) -> list:
            out: list[list] = [[], [], [], []]
            for t, s in zip(texts, spans, strict=True):
                data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                for x in s or ():
                    change[x["first"]] += 1
                    change[x["last"] + length] -= 1
                gone = np.cumsum(change)[:-1] > 0
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                for column, x in zip(out, (len(data), int(gone.sum()), n_spans, data[~gone].tobytes()), strict=True):
                    column.append(x)
            return out

        return work

    joined = held.join(spans, ["a", "b"], "left")
    added = "n_bytes long, n_removed long, n_spans long, kept binary"
    out = with_python(joined, [names[text], "spans"], added, start)
    return restored(out, names, **{c: F.col(c) for c in ("n_bytes", "n_removed", "n_spans", "kept")})
