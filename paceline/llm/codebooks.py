"""Compression of vectors to short codes: product quantisation with whole-number codebooks.

Vectors are cut into equal parts, and each part position has a codebook of a few entries. The codebooks, parts *
entries * part length whole numbers in all, are broadcast; tasks take Arrow batches of vectors and compute all
squared distances of a batch's parts to the entries as |a|^2 - 2ab + |b|^2 with exact integer products, and take the
first smallest. In a round each task adds up its parts by entry; a shuffle grouped by (part, entry, position) merges
these sums, and the driver takes the floors of the means. A last pass writes codes and errors.

Vectors are written once as whole numbers and read in every round; nothing else is kept, so a lost executor costs the
tasks it held. Rows meet no key but in sums with partial results.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are left out. The vector of the
smallest id whose length is a multiple of the parts gives the length of the code; vectors of other lengths are left
out too. Rows with null ids are coded but start no codebook; of rows with equal ids the smallest vector starts an
entry. Fewer ids than entries give fewer entries. Null labels, or a table without labels, form one group. An empty
table gives an empty result. Components of 2^62 / scale or more, and errors or sums of them beyond 64 bits, are an
error. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import cut, drop, small
from paceline.llm.vectors import as_longs, floor_mean, largest, matrix, squared_distances, whole_vectors

Books = np.ndarray  # parts x entries x part length


def first_books(rows: DataFrame, parts: int, entries: int) -> Books | None:
    """The parts of the vectors of the smallest ids; None without any."""
    usable = rows.filter(F.col("id").isNotNull() & (F.size("v") % parts == 0))
    found: dict = {}
    while len(found) < entries:
        # an id may have any number of rows, so the next ones are asked for behind the last id, not behind the last row
        behind = usable.filter((F.col("id") > max(found)) & (F.size("v") == length)) if found else usable
        got = behind.orderBy("id", "v").limit(entries).collect()
        if not got:
            break
        length = len(next(iter(found.values()), got[0].v))
        for r in got:
            if r.id not in found and len(r.v) == length and len(found) < entries:
                found[r.id] = r.v
    if not found:
        return None
    start = np.array([found[i] for i in sorted(found)], np.int64)
    return start.reshape(len(start), parts, -1).transpose(1, 0, 2)


def coded(v: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector and part, the index of the nearest entry and its squared distance."""
    d = [squared_distances(p, b) for p, b in zip(v.reshape(len(v), len(books), -1).transpose(1, 0, 2), books, strict=True)]
    at = np.stack([x.argmin(axis=1) for x in d], axis=1)
    return at, np.stack([x[np.arange(len(x)), i] for x, i in zip(d, at.T, strict=True)], axis=1)


def entry_sums(rows: DataFrame, books: Books) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (how many parts it took, their sums)} of the entries in use."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        parts, entries, width = books.shape
        total, count, bound = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64), 0

        def out() -> pa.RecordBatch:
            p, e = np.nonzero(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()), pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(np.repeat(count[p, e], width)), pa.array(total[p, e].ravel())],
                names=["part", "entry", "i", "n", "s"],
            )

        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                whole = matrix(part.column("v"), parts * width)
                most = max(largest(whole), 1)
                step = max(1, 2**62 // most)
                for v in (whole[i : i + step] for i in range(0, len(whole), step)):
                    if bound + most * len(v) >= 2**62:  # what is summed so far goes out before 64 bits overflow
                        yield out()
                        total[:], count[:], bound = 0, 0, 0
                    bound += most * len(v)
                    at, _ = coded(v, books)
                    cut_up = v.reshape(len(v), parts, width)
                    for p in range(parts):
                        taken = (at[:, p] == np.arange(entries)[:, None]).astype(np.int64)
                        total[p] += taken @ cut_up[:, p]
                        count[p] += taken.sum(axis=1)
        yield out()

    sums = rows.select("v").mapInArrow(run, "part int, entry int, i int, n long, s long")
    merged = sums.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
    for r in merged.collect():  # as many rows as numbers in the codebooks
        found.setdefault((r.part, r.entry), (r.n, {}))[1][r.i] = int(r.s)
    return {k: (n, [s[i] for i in range(len(s))]) for k, (n, s) in found.items()}


def learn(rows: DataFrame, books: Books, rounds: int) -> Books:
    """The codebooks after so many rounds; entries that nothing is near to stay as they are."""
    for _ in range(rounds):
        new = books.copy()
        for (p, e), (n, s) in entry_sums(rows, books).items():
            new[p, e] = floor_mean(s, n)
        if (new == books).all():
            break
        books = new
    return books


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """id, label, code and error of each vector."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                at, d = coded(matrix(part.column("v"), books.shape[0] * books.shape[2]), books)
                error = as_longs((d if largest(d) < 2**62 // len(books) else d.astype(object)).sum(axis=1))
                code = [bytes(x).hex() for x in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 by vector, and its label. entries: 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    named = F.col(label) if label in vectors.columns else F.lit(None).cast("int")
    rows = cut(whole_vectors(vectors, scale, vector, F.col(id_col).alias("id"), named.alias("label")))
    books = first_books(rows, parts, entries)
    if books is None:
        done = rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)['id']}, label {dict(rows.dtypes)['label']}, code string, error long")
        shown = ""
    else:
        same = rows.filter(F.size("v") == books.shape[0] * books.shape[2])
        books = learn(same, books, rounds)
        done = cut(encode(same, books))
        shown = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    drop(rows)
    # labels may be many: their sums are broadcast only if they are few
    sums = small(done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    out = done.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(shown).alias("codebooks_sha256"), F.col("label").alias(label))
