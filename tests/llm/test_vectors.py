"""Centroids and codebooks against plain Lloyd rounds in numpy and Python's integers, and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from paceline.llm import centroids, codebooks, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, error string, v string, id string"


def frame(spark, rows):
    """With columns named as the operators' own."""
    return spark.createDataFrame([(i, e, lab, "x", "y", "z", "w") for i, e, lab in rows], SCHEMA)


def cloud(n, dims, seed=0, spread=0.3):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [[float(np.float32(x + r.gauss(0, spread))) for x in r.choice(middles)] for _ in range(n)]


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def first(v, options):
    return min(range(len(options)), key=lambda c: (apart(v, options[c]), c))


def mean(members):
    return [sum(x) // len(members) for x in zip(*members, strict=True)]


def plain_lloyd(rows, k, rounds, scale, salt="2:"):
    vs = [whole(e, scale) for _, e, _ in rows]
    start = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for (i, _, _), v in zip(rows, vs, strict=True) if i is not None)
    cs = [v for _, v in start[:k]]
    for _ in range(rounds):
        own = [first(v, cs) for v in vs]
        cs = [mean(m) if (m := [v for v, o in zip(vs, own, strict=True) if o == c]) else cs[c] for c in range(len(cs))]
    own = [first(v, cs) for v in vs]
    return own, [apart(v, cs[o]) for v, o in zip(vs, own, strict=True)], cs


@pytest.mark.parametrize("rounds", [0, 1, 5, 30])
def test_delta_rounds_are_lloyd_rounds(spark, rounds):
    rows = [(i, e, i % 3) for i, e in enumerate(cloud(150, 4, rounds))]
    rows += [(None, [0.1, 0.2, 0.3, 0.4], None), (7, rows[9][1], None), (200, rows[9][1], None)] + [(1000 + i, rows[0][1], 0) for i in range(80)]
    own, d, cs = plain_lloyd(rows, 12, rounds, 256)
    got = centroids.cluster(frame(spark, rows), k=12, rounds=rounds, dims=4).collect()
    key = lambda x: str(x)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(((i, o, x) for (i, _, _), o, x in zip(rows, own, d, strict=True)), key=key)
    for r in got:
        assert r.cluster_inertia == sum(x for o, x in zip(own, d, strict=True) if o == r.cluster) and r.inertia == sum(d)
        assert r.centroid == cs[r.cluster] and r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_a_centroid_may_lose_all_its_vectors(spark):
    """Three equal first centroids: the first takes all, the others stay where they are."""
    rows = [(i, [1.0, 1.0], 0) for i in range(3)]
    got = centroids.cluster(frame(spark, rows), k=3, rounds=4, dims=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_nearest_compares_few_and_gives_the_same():
    r = np.random.default_rng(3)
    v, old = r.integers(-9, 9, (400, 3)), r.integers(-9, 9, (10, 3))
    owner = vectors.squared_distances(v, old).argmin(axis=1)
    new, changed = old.copy(), np.zeros(10, bool)
    for c in (2, 5):
        new[c] += 2
        changed[c] = True
    assert (centroids.nearest(v, owner, new, changed) == vectors.squared_distances(v, new).argmin(axis=1)).all()


ODD = [(1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1), (5, [1.0, float("inf")], 1), (6, [1.0, 2.0, 3.0], 1)]


def test_vectors_that_take_no_part(spark):
    some = [(i, e, None) for i, e in enumerate(cloud(20, 2), start=10)]
    assert sorted(r.vec_id for r in centroids.cluster(frame(spark, some + ODD), k=4, dims=2).collect()) == list(range(10, 30))
    got = codebooks.compress(frame(spark, some + ODD), parts=2, entries=4, rounds=2).collect()
    assert sorted(r.vec_id for r in got) == list(range(10, 30))
    for none in (frame(spark, ODD), frame(spark, []), frame(spark, [(None, [1.0, 2.0], 1)])):
        assert centroids.cluster(none, dims=2).isEmpty() and codebooks.compress(none, parts=2).isEmpty()


def plain_codes(rows, parts, entries, rounds, scale):
    vs = [whole(e, scale) for _, e, _ in rows]
    width = len(vs[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    least = {}
    for (i, _, _), v in zip(rows, vs, strict=True):
        if i is not None:
            least[i] = min(v, least.get(i, v))
    books = [[cut(least[i], p) for i in sorted(least)[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = [first(cut(v, p), books[p]) for v in vs]
            books[p] = [mean(m) if (m := [cut(v, p) for v, o in zip(vs, own, strict=True) if o == e]) else b for e, b in enumerate(books[p])]
    codes = [[first(cut(v, p), books[p]) for p in range(parts)] for v in vs]
    errors = [sum(apart(cut(v, p), books[p][c]) for p, c in enumerate(code)) for v, code in zip(vs, codes, strict=True)]
    return ["".join(f"{c:02x}" for c in code) for code in codes], errors, [x for b in books for e in b for x in e]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(2, 16, 6), (3, 5, 1), (1, 40, 3), (6, 3, 0)])
def test_codes_against_plain_rounds(spark, parts, entries, rounds):
    rows = [(i, e, i % 4 if i % 5 else None) for i, e in enumerate(cloud(90, 6, parts))]
    rows += [(None, rows[3][1], None), (3, rows[8][1], 2), (8, rows[8][1], 2)] + [(500 + i, rows[0][1], 0) for i in range(60)]
    codes, errors, books = plain_codes(rows, parts, entries, rounds, 4096)
    got = codebooks.compress(frame(spark, rows), parts, entries, rounds).collect()
    by_label = {lab: sum(x for (_, _, a), x in zip(rows, errors, strict=True) if a == lab) for lab in {a for _, _, a in rows}}
    want = [(i, c, x, by_label[lab]) for (i, _, lab), c, x in zip(rows, codes, errors, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()}


def test_labels_may_be_absent_or_many(spark):
    rows = [(i, e, i) for i, e in enumerate(cloud(40, 4))]
    one = codebooks.compress(frame(spark, rows).drop("label"), parts=2)
    assert {r.label_error for r in one.collect()} == {sum(r.error for r in one.collect())}
    assert all(r.label_error == r.error for r in codebooks.compress(frame(spark, rows), parts=2).collect())


@pytest.mark.parametrize("size", [10, 10**6, 10**12, 10**17])
def test_distances_are_exact_at_every_size(size):
    r = random.Random(size)
    a, b = ([[r.randint(-size, size) for _ in range(5)] for _ in range(9)] for _ in range(2))
    got = vectors.squared_distances(np.array(a, np.int64), np.array(b, np.int64))
    assert got.tolist() == [[apart(x, y) for y in b] for x in a]


def test_large_components(spark):
    """Distances to far centroids exceed 64 bits, those to the own one don't."""
    rows = [(i, [s * 3e7, float(i)], 0) for i in range(6) for s in (1.0, -1.0)]
    rows = [(n, e, lab) for n, (_, e, lab) in enumerate(rows)]
    own, d, _ = plain_lloyd([(i, [float(np.float32(x)) for x in e], lab) for i, e, lab in rows], 4, 3, 256)
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(frame(spark, rows), k=4, rounds=3, dims=2).collect()}
    assert got == {i: (o, x) for (i, _, _), o, x in zip(rows, own, d, strict=True)}
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0], 0)]), dims=2)


def test_sums_go_out_before_they_overflow(spark):
    rows = [(i, [float(2**44), 1.0], 0) for i in range(200)]  # 2^56 each: 200 of them pass 2^62
    got = codebooks.compress(frame(spark, rows).coalesce(1), parts=1, entries=1, rounds=2).collect()
    assert {(r.code, r.error) for r in got} == {("00", 0)}
