"""Exact n-gram Jaccard self-join by index lists, and the groups it links.

Documents become sets of word n-grams (64-bit hashes made of cryptographic hashes of the words). Equal sets are joined
first, by their fingerprint; a second one of 64 more bits tells apart different sets whose first ones clash. Every other
set is indexed under its first few n-grams in one global order: two sets over the threshold share one of those. The
order puts n-grams that many documents hold last, so lists stay short.

Set relations save most of the work on a list:

* Skipping. Entries stand by their n-gram's position in their set. From positions and sizes follows the most that two
  sets can share, so each entry meets just the block of entries around its own position; the rest is skipped. A
  16-byte parity sketch gives a lower bound on the symmetric difference of those it meets.
* Derived answers. On a list of more than FEW entries, the first entry not yet attached leads: all entries that may be
  linked with it are its answers, and are attached. What links with the leader is in the leader's group, so answers
  among the attached follow from those of the leader. After the leaders' pairs are verified and groups are known, a
  second round looks only at pairs whose groups differ; that makes up for attachments that failed.

What is left is screened by longer sketches, half a bit for each n-gram, of which two are compared by the length of
the shorter. Then pairs are verified on the whole sets, made again for the few that need it: a map of bits, of bounded
size, tells tasks which texts may be wanted, and only those move. The sets of all that answer one leader are streamed
past the leader's, large groups split by a salt. Groups are connected components by minimum labels with pointer jumping.

Defined cases: null texts and texts without words have no n-grams and are linked with nothing; texts of fewer words
than n are one n-gram; repeated rows and copies share a group; a null id is the least id of a group only if all its
ids are null; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import aside, cut, drop, restored

FEW = 16
MOST_COMMON = 500_000
SPLIT = 500
MAP_BITS = 1 << 26
WORDS = 100_000
GATHERED = 4_000_000
SIG_MASK = -1
MOST_CLASHES = 1000
PER_FILE = 250_000  # labels in a file of a round's table
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, each made once, as long as there are not too many."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest())
        if len(word) <= 32:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_words = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * FACTOR
    return h ^ (h >> np.uint64(29))


def ngrams(text: str | None, n: int) -> np.ndarray:
    """The distinct word n-grams of the whole text, as sorted hashes; A-Z count as a-z."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at exactly the six spaces
    if not parts:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mixed(out * FACTOR + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def fingerprint(grams: np.ndarray, mask: int = -1) -> tuple[int, int]:
    """The fingerprint of a set, and a second one that tells two sets of equal fingerprints apart."""
    sig, check = struct.unpack("<qq", blake2b(grams.tobytes(), digest_size=16).digest())
    return sig & mask, check


def parities(grams: np.ndarray) -> bytes:
    """For half as many classes as n-grams, 256 at least: whether an odd number of n-grams falls in it.

    Classes are remainders by powers of two, so a sketch folds to half its length by XOR. Each n-gram by which two
    sets differ changes one class, so the bits that differ are no more than the n-grams that do.
    """
    m = 1 << max(8, (len(grams) - 1).bit_length() - 1)
    return np.packbits((np.bincount((_mixed(grams) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    a, b = int.from_bytes(x), int.from_bytes(y)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y, a, b = y, x, b, a
        half = len(x) // 2
        a = (a >> 8 * half) ^ (a & (1 << 8 * half) - 1)
        x = x[:half]
    return (a ^ b).bit_count()


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _surveyed(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (id, text hash, fingerprints, size) and rows of n-grams that some part holds often."""
    schema = pa.schema([("id", pa.int64()), ("b", pa.binary()), ("sig", pa.int64()), ("also", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())])
    mask = SIG_MASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def often() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            grams = np.unique(every[3:][every[3:] == every[:-3]])  # those there four times
            times = np.searchsorted(every, grams, "right") - np.searchsorted(every, grams)
            none = [None] * len(grams)
            return _rows([none, none, none, none, none, none, grams.view(np.int64), times], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, bs, texts = (batch.column(i).slice(at, 512).to_pylist() for i in range(3))
                sets = [ngrams(t, n) for t in texts]
                held.append(np.concatenate(sets))
                total += len(held[-1])
                none = [None] * len(ids)
                sig, also = zip(*(fingerprint(s, mask) if len(s) else (None, None) for s in sets), strict=True)
                yield _rows([ids, bs, sig, also, [len(s) for s in sets], [parities(s) for s in sets], none, none], schema)
                if total > GATHERED:
                    yield often()
                    total = 0
        if held:
            yield often()

    return docs.mapInArrow(run, "id long, b binary, sig long, also long, size long, sketch binary, gram long, times long")


INDEX = "gram long, sig long, size int, pos int, s0 long, s1 long"


def _indexed(docs: DataFrame, n: int, num: int, den: int, common, clashes: frozenset[int]) -> DataFrame:
    """The entries of all sets, equal sets of a task once. common: a broadcast of (n-grams that many hold, sorted; their counts)."""
    mask = SIG_MASK
    schema = pa.schema([("gram", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = common.value
        met: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                parts = []
                for t in batch.column(0).slice(at, 512).to_pylist():
                    s = ngrams(t, n)
                    if not len(s):
                        continue
                    sig, also = fingerprint(s, mask)
                    sig = also if sig in clashes else sig
                    if sig in met:
                        continue
                    met.add(sig)
                    first = len(s) - (num * len(s) + den - 1) // den + 1
                    sketch = np.packbits((np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1).astype(np.uint8)).view(np.int64)
                    if len(grams):
                        k = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                        many = np.where(grams[k] == s, counts[k], 0)
                        chosen = s[np.argsort(many, kind="stable")[:first]] if many.any() else s[:first]
                    else:
                        chosen = s[:first]
                    m = len(chosen)
                    parts.append((chosen.view(np.int64), np.full(m, sig), np.full(m, len(s)), np.arange(m), np.full(m, sketch[0]), np.full(m, sketch[1])))
                if parts:
                    yield _rows([np.concatenate(c).astype(t.to_pandas_dtype()) for c, t in zip(zip(*parts, strict=True), schema.types, strict=True)], schema)

    return docs.mapInArrow(run, INDEX)


def least_shared(a, b, num: int, den: int):
    """How many n-grams sets of sizes a and b must share."""
    return (num * (a + b) + num + den - 1) // (num + den)


class Block:
    """The entries of one list, by position."""

    def __init__(self, columns: list[np.ndarray], num: int, den: int, sketches: np.ndarray | None = None):
        self.order = order = np.lexsort((columns[0], columns[1], columns[2]))
        self.sig, self.size, self.pos, self.s0, self.s1 = (c[order] for c in columns)
        self.sketches = None if sketches is None else sketches[order]
        self.size, self.pos = self.size.astype(np.int64), self.pos.astype(np.int64)
        self.num, self.den = num, den

    def near(self, i: int) -> np.ndarray:
        """The places of entries that may be linked with entry i."""
        num, den = self.num, self.den
        reach = self.size[i] * (den - num) // num + 1  # at other positions too little is left to share
        lo, hi = np.searchsorted(self.pos, [self.pos[i] - reach, self.pos[i] + reach + 1])
        size, pos = self.size[lo:hi], self.pos[lo:hi]
        need = least_shared(size, self.size[i], num, den)
        most = np.minimum(pos, self.pos[i]) + 1 + np.minimum(size - pos, self.size[i] - self.pos[i]) - 1
        ok = most >= need
        apart = np.bitwise_count((self.s0[lo:hi] ^ self.s0[i]).view(np.uint64)).astype(np.int64) + np.bitwise_count((self.s1[lo:hi] ^ self.s1[i]).view(np.uint64))
        ok &= apart <= size + self.size[i] - 2 * need
        ok &= self.sig[lo:hi] != self.sig[i]
        found = np.flatnonzero(ok)
        if self.sketches is not None and len(found):
            most = size + self.size[i] - 2 * need
            found = np.array([j for j in found if bits_apart(self.sketches[i], self.sketches[lo + j]) <= most[j]], np.int64)
        return found + lo


def _complete(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns, and where in them the lists of more than one entry begin and how long they are, from batches in which a
    gram's entries stand together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(size)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        n = np.diff(np.r_[0, cuts])
        starts = np.r_[0, cuts[:-1]][: len(n)]
        if (n > 1).any():
            yield columns, starts[n > 1], n[n > 1]
        last = cuts[-1] if len(cuts) else 0
        held = [c[last:] for c in columns]
    if held is not None and len(held[0]) > 1:
        yield held, np.array([0]), np.array([len(held[0])])


def _lists(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The rows of each gram's list, from batches in which they stand together."""
    for columns, starts, lengths in _complete(batches, size):
        for lo, m in zip(starts, lengths, strict=True):
            yield [c[lo : lo + m] for c in columns]


def _near_pairs(columns: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y), x the smaller, of all pairs within short lists that may be linked, as Block.near tells one by one."""
    sig, size, pos, s0, s1 = columns
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    behind = np.repeat(lengths, lengths) - 1 - within
    i = np.repeat(np.repeat(starts, lengths) + within, behind)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
    size, pos = size.astype(np.int64), pos.astype(np.int64)
    a, b = size[i], size[j]
    spare = np.minimum(pos[i], pos[j]) + np.minimum(a - pos[i], b - pos[j]) - least_shared(a, b, num, den)
    ok = (spare >= 0) & (sig[i] != sig[j])
    i, j, most = i[ok], j[ok], (a + b - 2 * least_shared(a, b, num, den))[ok]
    apart = np.bitwise_count((s0[i] ^ s0[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64))
    x, y = sig[i[apart <= most]], sig[j[apart <= most]]
    return np.minimum(x, y), np.maximum(x, y)


PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("gram", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64())])


def _first_round(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x leads y) of all lists, and again the attached entries of lists with more than FEW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        large: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                x, y = zip(*found, strict=True)
                none = [None] * len(x)
                yield _rows([x, y, *[none] * 6], PAIRS)
                found.clear()
            if large:
                columns = [np.concatenate(c) for c in zip(*large, strict=True)]
                none = [None] * len(columns[0])
                yield _rows([none, none, *columns], PAIRS)
                large.clear()

        for columns, starts, lengths in _complete(batches, 6):
            short = lengths <= FEW
            if short.any():
                found.update(zip(*(v.tolist() for v in _near_pairs(columns[1:], starts[short], lengths[short], num, den)), strict=True))
            for lo, n in zip(starts[~short], lengths[~short], strict=True):
                own = [c[lo : lo + n] for c in columns]
                block = Block(own[1:], num, den)
                attached = np.zeros(n, bool)
                for i in range(n):
                    if attached[i]:
                        continue
                    for j in block.near(i):
                        attached[j] = True
                        found.add((int(block.sig[i]), int(block.sig[j])))
                # a leader has met its whole list, and so has an entry that none may be linked with
                if attached.sum() > 1:
                    again = block.order[attached]
                    large.append([c[again] for c in own])
            if len(found) > 100_000 or sum(len(c[0]) for c in large) > 100_000:
                yield from out()
        yield from out()

    # dealt by n-gram once; that also brings together what tasks give of equal sets
    dealt = entries.repartition("gram").dropDuplicates(["gram", "sig"]).sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "x long, y long, " + INDEX)


def _second_round(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of entries with different groups, from lists of gram, sig, size, pos, s0, s1, label, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        found: set[tuple[int, int]] = set()
        for columns in _lists(batches, 8):
            if (columns[6] == columns[6][0]).all():
                continue
            block = Block(columns[1:6], num, den, columns[7])
            label = columns[6][block.order]
            kinds, which, count = np.unique(label, return_inverse=True, return_counts=True)
            common = count.argmax()  # pairs within the largest group needn't be looked at
            for i in np.flatnonzero(which != common):
                for j in block.near(i):
                    if label[i] != label[j]:
                        a, b = int(block.sig[i]), int(block.sig[j])
                        found.add((min(a, b), max(a, b)))
            if len(found) > 100_000:
                yield _rows(list(zip(*found, strict=True)), schema)
                found.clear()
        if found:
            yield _rows(list(zip(*found, strict=True)), schema)

    return entries.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "x long, y long")


def _screened(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sketches, of sketches (sig, size, sketch), don't rule a link out."""
    one = sketches.select(F.col("sig").alias("x"), F.col("size").alias("nx"), F.col("sketch").alias("kx"))
    two = sketches.select(F.col("sig").alias("y"), F.col("size").alias("ny"), F.col("sketch").alias("ky"))
    both = pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", "kx", "ky")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        for batch in batches:
            keep = [bits_apart(r["kx"], r["ky"]) <= r["nx"] + r["ny"] - 2 * least_shared(r["nx"], r["ny"], num, den) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], schema=schema)

    return both.mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that are linked. sets: sig, grams (packed)."""
    loads = pairs.groupBy("x").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    members = pairs.join(loads, "x").select("x", F.col("y").alias("sig"), F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"))
    leaders = loads.select("x", F.col("x").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = members.unionByName(leaders).join(sets, "sig").withColumn("is_y", (F.col("sig") != F.col("x")).cast("int"))
    dealt = wanted.repartition("x", "part").sortWithinPartitions("x", "part", "is_y").select("x", "part", "is_y", "sig", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        lead = None
        for batch in batches:
            got = []
            for x, is_y, sig, grams in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if not is_y:
                    lead = own
                elif len(own) and lead is not None:
                    k = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    both = int((lead[k] == own).sum())
                    if den * both >= num * (len(own) + len(lead) - both):
                        got.append((x, sig))
            if got:
                yield _rows(list(zip(*got, strict=True)), schema)

    return dealt.mapInArrow(run, "x long, y long")


def _marked(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts whose hash may be among the chosen ones: a map of MAP_BITS bits, in MAP_BITS / 64 rows at most, goes to
    all tasks, so that few texts that aren't wanted are moved."""
    def place(b: Column) -> Column:
        return F.pmod(F.xxhash64(b), F.lit(MAP_BITS))

    bit = F.expr("shiftleft(1L, cast(k & 63 as int))")
    marks = chosen.select(place(F.col("b")).alias("k")).groupBy(F.shiftright("k", 6).alias("word")).agg(F.bit_or(bit).alias("marks"))
    own = texts.withColumn("k", place(F.col("b"))).withColumn("word", F.shiftright("k", 6))
    return own.join(F.broadcast(marks), "word").filter(F.col("marks").bitwiseAND(bit) != 0).select(*texts.columns)


def components(links: DataFrame) -> DataFrame:
    """(v, label): for each end of a link (x, y) the least end that it reaches."""
    both = cut(links.select("x", "y").union(links.select("y", "x")).distinct())
    held = cut(both.groupBy(F.col("x").alias("v")).agg(F.least(F.first("x"), F.min("y")).alias("label")).withColumn("old", F.lit(None).cast("long")))
    files = 1 + held.count() // PER_FILE  # every round's table has as many rows
    while True:
        labels = held.select("v", "label")
        near = both.join(labels.select(F.col("v").alias("y"), "label"), "y").groupBy(F.col("x").alias("v")).agg(F.min("label").alias("near"))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("v").alias("mid"), F.col("label").alias("far"))
        new = cut(new.join(jump, "mid", "left").select("v", F.least("mid", "far").alias("label"), "old").coalesce(files))
        drop(held)
        held = new
        if new.filter("label < old").isEmpty():
            drop(both)
            return new.select("v", "label")


def _grouped(docs: DataFrame, n: int, num: int, den: int, text: str, key: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows of docs, set aside, with their size, their group (null without n-grams) and its first (id, text hash)."""
    held, names = aside(docs)
    held = held.withColumn("id", F.col(names[key]).cast("long")).withColumn("b", F.substring(F.unhex(F.sha2(names[text], 256)), 1, 16))
    texts = held.select("id", "b", F.col(names[text]).cast("string").alias("text"))
    survey = cut(_surveyed(texts, n))
    base = survey.filter(F.col("gram").isNull()).select("id", "b", "sig", "also", "size", "sketch")
    # different sets of equal fingerprints, of which there are next to none, are told apart by the second one
    unlike = base.groupBy("sig").agg((F.min("also") != F.max("also")).alias("unlike")).filter("unlike").select("sig").limit(MOST_CLASHES + 1).collect()
    if len(unlike) > MOST_CLASHES:
        raise ValueError("fingerprints of sets clash far more often than hashes do")
    clashes = frozenset(r.sig for r in unlike)
    if clashes:
        base = base.withColumn("sig", F.when(F.col("sig").isin(*clashes), F.col("also")).otherwise(F.col("sig")))
    # one document of each set stands for it, chosen with partial sums: a set may be that of a third of all documents
    kinds = base.filter(F.col("sig").isNotNull()).groupBy("sig").agg(
        F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "b")).alias("first")
    )
    kinds = cut(kinds)
    often = cut(survey.filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("times").alias("times")))
    # the lowest of these counts that MOST_COMMON n-grams at most reach, so that they can go to all tasks
    bounds = [8 << k for k in range(40)]
    above = often.agg(*(F.coalesce(F.sum((F.col("times") >= t).cast("long")), F.lit(0)).alias(str(k)) for k, t in enumerate(bounds))).first()
    least = next(t for k, t in enumerate(bounds) if above[k] <= MOST_COMMON)
    most = often.filter(F.col("times") >= least).toArrow()
    drop(often)
    grams = most["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    common = docs.sparkSession.sparkContext.broadcast((grams[order], most["times"].to_numpy()[order]))

    entries = _indexed(texts.select("text"), n, num, den, common, clashes)
    first = cut(_first_round(entries, num, den))

    def verified(found: DataFrame) -> DataFrame:
        """The links among pairs of fingerprints, from the texts of one document each."""
        pairs = cut(_screened(found, kinds, num, den))
        active = pairs.select(F.col("x").alias("sig")).union(pairs.select("y")).distinct()
        chosen = cut(kinds.join(active, "sig", "left_semi").select("sig", F.col("first.b").alias("b"), F.col("first.id").alias("own")))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("sig", pa.int64()), ("grams", pa.binary())])
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    got = [ngrams(t, n) for t in batch.column(1).slice(at, 256).to_pylist()]
                    yield _rows([batch.column(0).slice(at, 256), [g.tobytes() for g in got]], schema)

        wanted = _marked(texts, chosen).join(chosen.hint("merge"), ["b"]).filter(F.col("id").eqNullSafe(F.col("own"))).select("sig", "text")
        # equal rows give a set twice, which changes no link
        whole = cut(wanted.mapInArrow(sets, "sig long, grams binary"))
        links = cut(_verified(pairs, whole, num, den))
        drop(pairs, chosen, whole)
        return links

    pairs = cut(first.filter(F.col("x").isNotNull()).select("x", "y").distinct())
    links = verified(pairs)
    labels = components(links)
    large = first.filter(F.col("gram").isNotNull()).select("gram", "sig", "size", "pos", "s0", "s1")
    large = large.join(labels.withColumnRenamed("v", "sig"), "sig", "left").join(kinds.select("sig", "sketch"), "sig")
    large = large.select("gram", "sig", "size", "pos", "s0", "s1", F.coalesce("label", "sig").alias("label"), "sketch")
    known = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = cut(_second_round(large, num, den).distinct().join(known, ["x", "y"], "left_anti"))
    if not more.isEmpty():
        again = verified(more)
        labels = components(links.unionByName(again))
        drop(again)
    drop(first, pairs, more, links)

    marked = kinds.select("sig", "first").join(labels.withColumnRenamed("v", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    first_of = marked.groupBy("label").agg(F.min("first").alias("least"))
    by_set = marked.select("sig", "label").join(first_of, "label").select("sig", "label", "least")
    by_text = base.groupBy("b").agg(F.first("size").alias("n_shingles"), F.first("sig").alias("sig")).join(by_set, "sig", "left")
    found = by_text.select("b", "n_shingles", "label", F.col("least.id").alias("least"), F.col("least.b").alias("least_b"))
    return held.join(found.withColumnRenamed("b", "text_b"), F.col("b").eqNullSafe(F.col("text_b")), "left").drop("text_b"), names


def linked(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with n_shingles and component_id, the least id of those reached by links."""
    out, names = _grouped(docs, n, num, den, text, key)
    return restored(out, names, n_shingles=F.col("n_shingles"), component_id=F.coalesce("least", "id"))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, one for each group of linked documents: that of the least id, null if all are."""
    out, names = _grouped(docs, n, num, den, text, key)
    first = F.col("id").eqNullSafe(F.col("least")) & (F.col("b") == F.col("least_b"))
    out = out.filter(F.col("label").isNull() | first)
    # rows equal in id and text are left; those without n-grams are linked with nothing and stay
    out = out.withColumn("apart", F.when(F.col("label").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return restored(out.dropDuplicates(["b", "id", "apart"]), names)
