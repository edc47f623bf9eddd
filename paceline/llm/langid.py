"""Language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn from its code point. A trigram is
the product of its letters' vectors, each rolled by its place; a document is the sum of its trigrams' vectors, and a
language's prototype is the sum of its documents', each weighted by one over its trigrams. A document gets the
language whose prototype has the highest cosine with it.

Training is one pass: each task sums the vectors of its rows by language, and Spark sums those. The model is
languages x dimensions numbers, whatever the rows. Both passes take whole texts, in slices of the symbols.

Defined cases: null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned;
rows with a null language or no letter teach nothing; equal cosines go to the first language by code point; columns
named like the added ones are replaced; repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import aside, cut, restored, with_python

SLICE = 2_000_000
WIDTH = 1 << 15
MODEL_BYTES = 64 << 20


class Space:
    """Vectors of letters and trigrams; one per worker process."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.index = np.full(0x110000, -1, np.int32)
        self.rolled = np.empty((3, 0, dims), np.int8)
        self._learn(np.array([32]))

    def _learn(self, points: np.ndarray) -> None:
        new = np.stack([np.random.default_rng([self.seed, int(p)]).integers(0, 2, self.dims, np.int8) * 2 - 1 for p in points])
        self.index[points] = np.arange(len(points)) + self.rolled.shape[1]
        self.rolled = np.concatenate([self.rolled, np.stack([np.roll(new, 2 - k, axis=1) for k in range(3)])], axis=1)

    def symbols(self, text: str) -> np.ndarray:
        """Indexes of lower-case letters, runs of anything else as one gap; empty without a letter."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter[points]
        if not is_letter.any():
            return np.empty(0, np.int32)
        keep = is_letter.copy()
        keep[0] = True
        keep[1:] |= is_letter[:-1]
        points = np.where(is_letter, points, 32)[keep]
        found = self.index[points]
        if (found < 0).any():
            self._learn(np.unique(points[found < 0]))
            found = self.index[points]
        return found

    def trigrams(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, and which of them each is."""
        if size <= 256:
            there = np.zeros(size**3, bool)
            there[codes] = True
            found = np.flatnonzero(there)
            place = np.empty(size**3, np.int32)
            place[found] = np.arange(len(found))
            return found, place[codes]
        return np.unique(codes, return_inverse=True)

    def slices(self, each: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, counts (texts x distinct trigrams) and those trigrams' vectors, for slices of all symbols and
        WIDTH distinct trigrams of each at a time, so that memory doesn't grow with the alphabet."""
        flat = np.concatenate([*each, np.empty(0, np.int32)]).astype(np.int64)
        doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
        size = self.rolled.shape[1]
        for at in range(0, len(flat) - 2, SLICE):
            s, d = flat[at : at + SLICE + 2], doc[at : at + SLICE + 2]
            codes = (s[:-2] * size + s[1:-1]) * size + s[2:]
            whole = d[:-2] == d[2:]
            codes, d = codes[whole], d[:-2][whole]
            if len(codes):
                found, which = self.trigrams(codes, size)
                first, n = d[0], d[-1] - d[0] + 1
                for k in range(0, len(found), WIDTH):
                    own, here = found[k : k + WIDTH], slice(None)
                    if len(found) > WIDTH:
                        here = np.flatnonzero((which >= k) & (which < k + WIDTH))
                    at_own = (d[here] - first) * len(own) + which[here] - k
                    counts = np.bincount(at_own, minlength=n * len(own)).reshape(n, len(own))
                    a, b, c = own // size // size, own // size % size, own % size
                    vectors = self.rolled[0, a] * self.rolled[1, b] * self.rolled[2, c]
                    yield first, counts.astype(np.float32), vectors.astype(np.float32)

    def symbols_of(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.symbols(t) if t else np.empty(0, np.int32) for t in texts]

    def documents(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for first, counts, vectors in self.slices(self.symbols_of(texts)):
            out[first : first + len(counts)] += counts @ vectors
        return out


_spaces: dict[tuple[int, int], Space] = {}


def space(dims: int, seed: int) -> Space:
    if (dims, seed) not in _spaces:
        _spaces[dims, seed] = Space(dims, seed)
    return _spaces[dims, seed]


@dataclass(frozen=True)
class Profiles:
    langs: list[str]
    vectors: np.ndarray
    dims: int
    seed: int


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = 512, seed: int = 11) -> Profiles:
    """Prototypes of the languages in docs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = space(dims, seed), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts, langs = (batch.column(i).slice(at, 256).to_pylist() for i in (0, 1))
                kinds = sorted(set(langs))
                kind = np.array([kinds.index(x) for x in langs])
                each = own.symbols_of(texts)
                n = np.array([len(x) - 2 for x in each])  # trigrams
                got = np.zeros((len(kinds), dims))
                for first, counts, vectors in own.slices(each):
                    rows = np.arange(first, first + len(counts))
                    share = np.zeros((len(kinds), len(counts)), np.float32)
                    share[kind[rows], np.arange(len(counts))] = 1 / np.maximum(n[rows], 1)
                    got += (share @ counts) @ vectors
                for i, k in enumerate(kinds):
                    total[k] = total.get(k, 0) + got[i]
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [list(map(float, v)) for v in total.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(sums, "lang string, v array<double>")
    bundled = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    bundled = cut(bundled)
    langs = sorted(r.lang for r in bundled.select("lang").distinct().limit(MODEL_BYTES // dims // 8 + 1).collect())
    if len(langs) * dims * 8 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages make a model over {MODEL_BYTES} bytes")
    vectors = np.zeros((len(langs), dims))
    place = {x: i for i, x in enumerate(langs)}
    for r in bundled.collect():
        vectors[place[r.lang], r.i] = r.x
    some = (vectors != 0).any(axis=1)
    vectors = vectors[some]
    return Profiles([x for x, y in zip(langs, some, strict=True) if y], vectors / np.linalg.norm(vectors, axis=1, keepdims=True), dims, seed)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of docs with lang_pred and score (the cosine, 0 if negative)."""
    held, names = aside(docs)
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # at most MODEL_BYTES

    def start():
        m = model.value
        own = space(m.dims, m.seed)

        def work(texts: list) -> list:
            v = own.documents(texts)
            norm = np.linalg.norm(v, axis=1)
            known = (norm > 0) & bool(m.langs)
            if not m.langs:
                return [["und"] * len(texts), [0.0] * len(texts)]
            cosine = v @ m.vectors.T / np.maximum(norm, 1e-30)[:, None]
            best = cosine.argmax(axis=1)
            score = np.clip(np.where(known, cosine.max(axis=1), 0), 0, 1)
            return [[m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], score.tolist()]

        return work

    out = with_python(held, [names[text]], "lang_pred string, score double", start)
    return restored(out, names, lang_pred=F.col("lang_pred"), score=F.col("score"))
