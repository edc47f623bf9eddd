"""The operators on edge cases, on an empty table, and against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paceline.llm import bpe, jaccard, kneser_ney, langid, line_dedup, mixing, queries, rule_ensemble, sharding, suffix_dedup, topk
from tests.compare import connect, rows
from tests.llm.conftest import CLASHES, prose

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def check(out, given):
    """All rows come back, and the columns that the operator doesn't set."""
    assert out.count() == given.count()
    assert set(given.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    return out


# --- sharding


def test_sharding(edges, empty):
    got = check(sharding.shard(edges, 3), edges).toPandas()
    counts = got.groupby("shard").slot.agg(["count", "nunique", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["count"] == counts["nunique"]).all() and (counts["max"] + 1 == counts["count"]).all()
    assert got.loc[got.doc_id == 3, "size"].item() == 8
    assert sharding.shard(empty).isEmpty()


def test_sharding_mixes(spark):
    many = docs(spark, [str(i) for i in range(500)])
    got = sharding.shard(many, 5).toPandas().sort_values(["shard", "slot"])
    assert abs(np.corrcoef(got.doc_id, np.arange(500))[0, 1]) < 0.2


def test_sharding_against_its_law(spark):
    """Every row is in one place, with its size and CRC, and a shard is what its places say; files in other splits agree."""
    import zlib

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(frame, 24).withColumn("crc", F.crc32(F.encode("text", "UTF-8"))).toPandas()
    given = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    assert sorted(got.doc_id) == sorted(given)
    for r in got.itertuples():
        data = None if given[r.doc_id] is None else given[r.doc_id].encode()
        assert r.size == 8 + len(data or b"") and (r.crc == zlib.crc32(data) if data is not None else r.crc != r.crc)
    n = len(got)
    place = sorted(zip(got.shard, got.slot, strict=True))
    assert place == [(p * 24 // n, p - -(-(p * 24 // n) * n // 24)) for p in range(n)]
    other = sharding.shard(frame.repartition(7), 24).toPandas()
    assert set(zip(got.doc_id, got.shard, got.slot, strict=True)) == set(zip(other.doc_id, other.shard, other.slot, strict=True))


def test_equal_rows_are_spread(spark):
    rows_ = [(1, "same text")] * 900 + [(i, f"text {i}") for i in range(2, 302)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("place", "offset", "salt", "many")})
    got = sharding.shard(frame, 3, bucket_bytes=1000).toPandas()
    assert got.shard.value_counts().tolist() == [400, 400, 400] and set(got.place) == {"place"} and set(got.salt) == {"salt"}
    assert all(got[got.shard == s].doc_id.eq(1).mean() > 0.6 for s in range(3))


def test_written_shards(edges, spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shard(edges, 2).select("doc_id", "text", "shard", "slot"), path)
    assert spark.read.parquet(path).count() == edges.count()


# --- mixing


def test_mixing(edges, empty):
    got = check(mixing.mix(edges), edges).toPandas()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in got.text]
    assert got["size"].tolist() == words
    by = got.groupby(got.source.fillna("null")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 1).all() and (got.taken <= 2 * got["size"]).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert mixing.mix(empty).isEmpty()


def shares(sizes, weights, total, cap):
    """Targets by sharing the excess again and again."""
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while free and left > 1e-9:
        w = sum(weights[s] for s in free)
        give = {s: left * weights[s] / w for s in free}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def test_targets_by_repeated_sharing(spark):
    r = random.Random(3)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": r.randint(0, 1000) for i in range(n)}
        frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
        want = shares(sizes, {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2.0)
        assert got == pytest.approx(want, abs=1e-6)


def test_mixing_against_brute_force(spark):
    """Documents by key, whole epochs first, then the prefix of the order that fills the rest of the target."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    frame = frame.unionByName(frame.filter("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(frame.filter("doc_id < 5"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = frame.withColumn("key", -F.log(u) / mixing.quality_weight(F.col("text"))).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in keyed]
    sizes = collections.Counter()
    for r, n in zip(keyed, size, strict=True):
        sizes[r.source] += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = shares(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    want = collections.defaultdict(list)
    for s in sizes:
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        left = round(target[s] - epochs * sizes[s])
        for r, n in sorted(((r, n) for r, n in zip(keyed, size, strict=True) if r.source == s), key=lambda x: (x[0].key, x[0].doc_id is not None, x[0].doc_id or 0)):
            part = min(n, left)
            left -= part
            want[r.doc_id, r.text, s].append(epochs * n + part)
    got = collections.defaultdict(list)
    for r in mixing.mix(frame, rows_per_bucket=10).collect():
        got[r.doc_id, r.text, r.source].append(r.taken)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_mixing_prefers_quality(spark):
    clean, junk = ["plain words in a row here"] * 200, ["### *** $$$ %%% &&& |||"] * 200
    texts = docs(spark, [f"{t} {i}" for i, t in enumerate(clean + junk)]).withColumn("source", F.lit("s"))
    two = spark.createDataFrame([(10_000, "x " * 100_000, "t")], "doc_id long, text string, source string")  # takes most of the share
    got = mixing.mix(texts.unionByName(two), weights=(1, 300), share=1.0).filter("source = 's'").toPandas()
    taken = got.assign(clean=~got.text.str.contains("#")).groupby("clean").taken.sum()
    assert taken[True] > 1.5 * taken[False]


# --- byte-level BPE


def test_bpe_equals_the_definition():
    import tiktoken

    ranks = bpe.read_ranks(PATH)
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    for n in range(1500):
        text = "".join(r.choice("aeinst  \n'!?0é中ß\x1c\xa0=-") for _ in range(r.randint(0, 60))) + "a" * (n % 50)
        for _ in range(2):  # the second time by arrows
            ids = np.frombuffer(own.encode(text), "<u4").tolist()
            assert ids == other.encode_ordinary(text)
        assert own.decode(own.encode(text), n=1 + n % 3) == text


def test_small_transducer_resets():
    ranks = bpe.read_ranks(PATH)
    small, large = bpe.Transducer(ranks, max_states=3), bpe.Transducer(ranks)
    for word in prose(9, 300).split():
        assert small.encode(word.encode()) == large.encode(word.encode()) == small.encode(word.encode())


def test_utf8_stream():
    data = "aé中😀z".encode()
    for cut in range(len(data)):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.end() == "aé中😀z"
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xf0\x9f") == "a" and s.end() == "�"


def test_bpe_frames(edges, empty):
    out = check(bpe.decode(bpe.encode(edges, PATH), PATH), edges).toPandas()
    assert (out.decoded == out.text.fillna("")).all() and out.loc[out.doc_id == 3, "n_tokens"].item() == 0
    assert bpe.decode(bpe.encode(empty, PATH), PATH).isEmpty()
    both = check(bpe.round_trip(edges, PATH), edges).toPandas()
    key = ["doc_id", "text"]
    assert both.sort_values(key)[["n_tokens", "ids", "decoded"]].values.tolist() == out.sort_values(key)[["n_tokens", "ids", "decoded"]].values.tolist()
    assert bpe.round_trip(empty, PATH).isEmpty()


# --- languages


def test_languages(edges, empty, spark):
    profiles = langid.learn(edges)
    got = check(langid.identify(edges, profiles), edges).toPandas()
    assert set(got[got.doc_id.isin([3, 4, 6, 8])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    none = langid.identify(edges, langid.learn(empty)).toPandas()
    assert set(none.lang_pred) == {"und"} and (none.score == 0).all()
    assert langid.identify(empty, profiles).isEmpty()


def test_language_accuracy(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_long_texts_are_sliced(monkeypatch):
    own, text = langid.Space(64, 1), prose(4, 3000)
    whole = own.documents([text, "ab"])
    monkeypatch.setattr(langid, "SLICE", 100)
    assert np.allclose(own.documents([text, "ab"]), whole)
    monkeypatch.setattr(langid, "WIDTH", 7)
    assert np.allclose(own.documents([text, "ab"]), whole)


def test_languages_against_brute_force(spark):
    """Prototypes and cosines by their definition, trigram by trigram."""
    own = langid.Space(128, 3)

    def vector(text):
        letters = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower(), flags=re.UNICODE).strip() + " "
        if not re.search(r"[^\W\d_]", text or ""):
            return np.zeros(128), 0
        base = {c: np.random.default_rng([3, ord(c)]).integers(0, 2, 128, np.int8) * 2 - 1 for c in set(letters)}
        grams = [np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in zip(letters, letters[1:], letters[2:], strict=False)]
        return np.sum(grams, axis=0), len(grams)

    texts = [(i, prose(i, 40) if i % 2 else " ".join(reversed(prose(i, 40).upper().split())) + " ñandú über", "ab"[i % 2]) for i in range(10)]
    frame = spark.createDataFrame([*texts, (10, "1 2", "a"), (11, None, "b")], "doc_id long, text string, lang string")
    totals = {}
    for _, t, k in texts:
        v, n = vector(t)
        totals[k] = totals.get(k, 0) + v / n
    names = sorted(totals)
    got = langid.identify(frame, langid.learn(frame, dims=128, seed=3)).orderBy("doc_id").collect()
    for (_, t, _), r in zip(texts, got, strict=False):
        v, _ = vector(t)
        assert np.allclose(own.documents([t])[0], v)
        cosine = [v @ totals[k] / np.linalg.norm(v) / np.linalg.norm(totals[k]) for k in names]
        assert r.lang_pred == names[int(np.argmax(cosine))] and r.score == pytest.approx(max(cosine), abs=1e-5)
    assert [(r.lang_pred, r.score) for r in got[10:]] == [("und", 0.0)] * 2


# --- quality


def test_classifier(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (7, 0), (8, 0), (8, None), (None, 0), (99, 1)], "doc_id long, quality int")
    got = rule_ensemble.classify(edges, labels, F.lit(True)).toPandas()
    assert len(got) == edges.count() and got.score.between(0, 1).all() and "text" not in got
    flat = rule_ensemble.classify(edges, labels.filter("quality = 1"), F.lit(True)).toPandas()
    assert flat.score.nunique() == 1
    assert rule_ensemble.classify(empty, labels, F.lit(True)).isEmpty()


def test_classifier_accuracy(spark):
    got = queries.op3_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.85


def test_rule_paths():
    printed = "Tree 0 (weight 1.0):\n  If (feature 0 <= 1.0)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.0)\n   Predict: 1.0\n"
    got = {r.bounds for r in rule_ensemble.paths(printed, ["a", "b"])}
    assert got == {(("a", True, 1.0),), (("a", True, 1.0), ("b", True, 2.0)), (("a", True, 1.0), ("b", False, 2.0)), (("a", False, 1.0),)}


def test_scores_against_rules_one_by_one(spark):
    """The compiled column gives what the rules and weights give, row by row; a very long labelled text is no exception."""
    r = random.Random(3)
    texts = [(i, prose(i, r.randint(5, 90)) if i % 3 else "### $$$ " * r.randint(1, 30)) for i in range(120)] + [(120, prose(7, 60_000)), (121, ""), (122, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 121, 2)], "doc_id long, quality int")
    stats = rule_ensemble.statistics(F.col("text"))
    held = frame.select("doc_id", *(c.alias(k) for k, c in stats.items()))
    ensemble = rule_ensemble.learn(held.join(labels, "doc_id"), list(stats), "quality")
    assert ensemble.terms
    got = {x.doc_id: x.score for x in rule_ensemble.classify(frame, labels, F.lit(True)).collect()}
    for row in held.withColumn("score", ensemble.score()).collect():
        z = ensemble.intercept
        for rule, weight in ensemble.terms:
            if all((row[s] <= v) if upper else (row[s] > v) for s, upper, v in rule.bounds):
                z += weight
        assert row.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert got[row.doc_id] == pytest.approx(row.score, abs=1e-3)  # a fit of its own, from the same rows
    assert len(got) == 123


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w, c in collections.Counter(windows).items() if c > 1}
    covered = {k for i, w in enumerate(windows) if w in many for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_statistics():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "é#", "\n", " ", "\x1c", "|", " c\t", "\x0b"]) for _ in range(r.randint(0, 60)))
        assert kneser_ney.base_stats(text) == slow_stats(text)


def test_quality_rules(edges, empty):
    got = check(kneser_ney.rules(edges), edges).toPandas()
    assert not got.loc[got.doc_id.isin([3, 4, 6, 7, 8]), "kept"].any()
    assert kneser_ney.rules(empty).isEmpty()


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney of one language by its formulas, over n-grams that two texts hold."""
    counts, held = collections.Counter(), collections.Counter()
    for t in texts:
        t = "\n" + t
        grams = [t[i : i + order] for i in range(len(t) - order + 1)]
        counts.update(grams)
        held.update(set(grams))
    tables = {order: {g: c for g, c in counts.items() if held[g] > 1}}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])

    def probability(g):
        k = len(g)
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        t = tables[k]
        own = {x: c for x, c in t.items() if x[:-1] == g[:-1]}
        if not own:
            return probability(g[1:])
        n = [0, *(sum(c == i for c in t.values()) for i in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.1), i - 0.1) for i in (1, 2, 3)]
        off = lambda c: d[min(c, 3)]
        total = sum(own.values())
        mass = sum(off(c) for c in own.values()) / total
        return (own[g] - off(own[g]) if g in own else 0) / total + mass * probability(g[1:])

    return probability


def test_kneser_ney_against_its_formulas(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on and on the cat ran"]
    frame = docs(spark, texts).withColumn("lang", F.lit("en"))
    arrays, p = kneser_ney.fit(frame, 3), plain_model(texts, 3)
    for t in [*texts, "the zebra sat", "xyz"]:
        padded = "\n" + t
        want = -sum(np.log(p(padded[i : i + 3])) for i in range(len(padded) - 2))
        assert arrays.surprise(t, "en") == pytest.approx(want, rel=1e-4)
    assert arrays.surprise("abc", "de") is None


def whole_model(texts, order):
    """Interpolated modified Kneser-Ney by its formulas, over all n-grams; those of one text pass their counts on."""
    counts, held = collections.Counter(), collections.defaultdict(set)
    for i, t in enumerate(texts):
        t = "\n" + t
        for g in (t[i : i + order] for i in range(len(t) - order + 1)):
            counts[g] += 1
            for k in range(order):
                held[g[k:]].add(i)
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])

    def probability(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        t = tables[len(g)]
        n = [0, *(sum(c == i for c in t.values()) for i in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.1), i - 0.1) for i in (1, 2, 3)]
        off = lambda x: d[min(t[x], 3)] if len(held[x]) > 1 else t[x]
        own = [x for x in t if x[:-1] == g[:-1]]
        return (t[g] - off(g) + sum(map(off, own)) * probability(g[1:])) / sum(t[x] for x in own)

    return probability


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on and on the cat ran", "zq zq zq xj"]


def surprises(spark, texts, langs, order):
    given = spark.createDataFrame(list(zip(range(len(texts)), texts, langs, strict=True)), "doc_id long, text string, lang string")
    return [x.surprise for x in kneser_ney.rules(given, order=order).orderBy("doc_id").collect()]


def formula(texts, order):
    p = whole_model(texts, order)
    return [-sum(np.log(p(f"\n{t}"[i : i + order])) for i in range(len(t) + 2 - order)) / len(t.split()) for t in texts]


@pytest.mark.parametrize("chunk", [30, 8_000_000])
def test_rules_count_all_ngrams(spark, monkeypatch, chunk):
    monkeypatch.setattr(kneser_ney, "CHUNK", chunk)
    alone = "eine sprache mit nur einem text"
    got = surprises(spark, [*TEXTS, alone, "no"], ["en"] * len(TEXTS) + [None, "fr"], 3)
    assert got[:-1] == pytest.approx([*formula(TEXTS, 3), *formula([alone], 3)], rel=1e-4)
    assert got[-1] == pytest.approx(formula(["no"], 3)[0], rel=1e-4)


def test_rules_keep_their_order_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", 4, raising=False)
    assert surprises(spark, TEXTS, ["en"] * len(TEXTS), 3) == pytest.approx(formula(TEXTS, 3), rel=1e-4)


def weighted(values):
    """The median as percentile_approx gives it: the least value that half of all reach."""
    return sorted(values)[(len(values) + 1) // 2 - 1]


def test_bands_against_brute_force(spark):
    """Gibberish lies above its language's band."""
    r = random.Random(4)
    usual = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(r.choices(usual, weights, k=r.randint(150, 400))) for _ in range(300)]
    texts.append(" ".join("".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(9)) for _ in range(200)))
    given = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = kneser_ney.rules(given).orderBy("doc_id").toPandas()
    ok = got[~got.base_failed & got.surprise.notna()]
    mid = weighted(ok.surprise)
    off = (ok.surprise - mid).abs() * 1.4826
    far, per_word = max(weighted(off), 0.02), weighted(off * np.sqrt(ok.n_words))
    width = 6 * np.sqrt(far**2 + per_word**2 / got.n_words.clip(lower=1))
    assert np.allclose(got.low, mid - width, rtol=1e-3) and np.allclose(got.high, mid + width, rtol=1e-3)
    inside = got.surprise.between(got.low, got.high) | got.surprise.isna()
    assert (got.kept == (~got.base_failed & inside)).all()
    assert got.surprise[300] > got.high[300] and not got.kept[300]
    assert got.kept[:300].mean() > 0.95


def test_low_band_rejects(spark):
    """Base rules look at windows of five words; a text that repeats less than that but has few kinds of words lies low."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(200)) for _ in range(200)]
    few = ["".join(r.choice(letters) for _ in range(5)) for _ in range(12)]
    texts += [" ".join(r.choice(few) for _ in range(200)) for _ in range(4)]
    given = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = kneser_ney.rules(given).orderBy("doc_id").toPandas()
    assert (got.surprise[200:] < got.low[200:]).all() and not got.base_failed[200:].any() and not got.kept[200:].any()
    assert got.kept[:200].all()


def test_no_letter_is_scored_as_another():
    text = "가a" + chr(ord("가") - 32749) + "😀"
    codes = np.concatenate(list(kneser_ney.codes(text, 1)))
    assert len(set(codes.tolist())) == 6  # the line end before the text, three letters and the two halves of the last


# --- line dedup


def slow_lines(texts, least):
    """Every run of lines, of any length, with enough words and an earlier copy goes."""
    split = [t.split("\n") for t in texts]
    first, gone = {}, set()
    for d, lines in enumerate(split):
        for i in range(len(lines)):
            for n in range(1, len(lines) - i + 1):
                run = "\n".join(lines[i : i + n])
                if first.setdefault((n, run), (d, i)) != (d, i) and len(re.findall(r"[^\x20\x09-\x0D]+", run)) >= least:
                    gone |= {(d, i + k) for k in range(n)}
    return ["\n".join(x for i, x in enumerate(lines) if (d, i) not in gone) for d, lines in enumerate(split)]


@pytest.mark.parametrize("rows", [7, 100_000])
def test_line_dedup_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "ROWS", rows)
    r = random.Random(8)
    texts = ["\n".join(r.choice(["a b c", "d e", "f g h i", "j", "", "k l m n o p"]) for _ in range(r.randint(1, 14))) for _ in range(40)]
    block = ["a", "b", "", "c d", "", "e", "f", "g", "h", "i", "j k"]
    texts += ["\n".join(["x" * i, *block, *["y"] * i, *block]) for i in range(4)]
    for least in (1, 6, 12):
        got = [x.text for x in line_dedup.dedup(docs(spark, texts), least).orderBy("doc_id").collect()]
        assert got == slow_lines(texts, least)


def test_runs_of_any_length_go(spark):
    """The threshold is on the whole run: three lines of four words, seven of two, a long line with short ones behind."""
    for run in (["a b c d", "e f g h", "i j k l"], ["a b"] + [f"{c} {c}" for c in "cdefgh"], [" ".join("w" * 60), "one two three", "four five six x"]):
        texts = ["\n".join([f"start {i}", *run, f"end {i}"]) for i in range(3)]
        got = [x.text for x in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
        assert got == [texts[0], "start 1\nend 1", "start 2\nend 2"]


def test_line_dedup_edges(edges, empty):
    got = check(line_dedup.dedup(edges), edges).toPandas()
    assert got.loc[got.doc_id == 3, "text"].isna().all() and got.loc[got.doc_id == 4, "text"].item() == ""
    assert line_dedup.dedup(empty).isEmpty()


# --- Jaccard join


def slow_groups(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, base, n, edits):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = base.split()
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"w{seed}x{i}y{r.randint(0, 9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_groups_against_brute_force(spark, n, num, den):
    texts = near_copies(1, prose(11, 150), 60, 4) + near_copies(2, prose(12, 40), 40, 2) + [prose(i, 60) for i in range(20, 60)] + ["", "one two", "One  two", None]
    chain = prose(77, 100).split()
    texts += [" ".join(chain[i : i + 80]) for i in range(12)]  # each linked with the next only
    got = jaccard.linked(docs(spark, texts), n, num, den).orderBy("doc_id").select("n_shingles", "component_id").collect()
    assert [tuple(x) for x in got] == slow_groups(texts, n, num, den)
    kept = {x.doc_id for x in jaccard.deduplicated(docs(spark, texts), n, num, den).collect()}
    assert kept == {i for i, (size, c) in enumerate(slow_groups(texts, n, num, den)) if c == i}


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    word = thue_morse(1024)
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    got = jaccard.linked(docs(spark, texts), 3, 90, 100).orderBy("doc_id").collect()
    assert [x.component_id for x in got] == [0, 1]


def test_pairs_of_short_lists_at_once_are_those_of_each_entry():
    """Ten thousand lists of 2 to 16 entries; all at once takes no Python step by entry."""
    rng = np.random.default_rng(7)
    for num in (80, 90):
        lengths = rng.integers(2, jaccard.FEW + 1, 10_000)
        starts, total = np.cumsum(lengths) - lengths, int(lengths.sum())
        size = rng.integers(5, 40, total).astype(np.int32)
        pos = np.minimum(rng.integers(0, 6, total), size - 1).astype(np.int32)
        sketch = np.int64(1) << rng.integers(0, 62, total)
        columns = [rng.integers(0, 5000, total), size, pos, sketch, np.roll(sketch, 1)]
        began = time.process_time()
        got = set(zip(*(v.tolist() for v in jaccard._near_pairs(columns, starts, lengths, num, 100)), strict=True))
        took = time.process_time() - began
        want, began = set(), time.process_time()
        for lo, m in zip(starts, lengths, strict=True):
            block = jaccard.Block([c[lo : lo + m] for c in columns], num, 100)
            for i in range(m):
                want |= {(int(min(block.sig[i], block.sig[j])), int(max(block.sig[i], block.sig[j]))) for j in block.near(i) if j > i}
        slow = time.process_time() - began
        print(len(want), took, slow)
        assert got == want and want and took < slow / 3


def test_clashing_fingerprints_are_told_apart(spark, monkeypatch):
    texts = near_copies(1, prose(11, 150), 10, 2) + [prose(i, 60) for i in range(20, 40)] + ["", "one two", "One  two", None]
    monkeypatch.setattr(jaccard, "SIG_MASK", 3)
    got = jaccard.linked(docs(spark, texts), 3, 90, 100).orderBy("doc_id").select("n_shingles", "component_id").collect()
    assert [tuple(x) for x in got] == slow_groups(texts, 3, 90, 100)


def test_full_map_of_wanted_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAP_BITS", 64)
    texts = near_copies(4, prose(14, 100), 12, 3) + [prose(i, 60) for i in range(20, 30)]
    got = jaccard.linked(docs(spark, texts), 3, 90, 100).orderBy("doc_id").select("n_shingles", "component_id").collect()
    assert [tuple(x) for x in got] == slow_groups(texts, 3, 90, 100)


def test_second_round(spark):
    """Chains on which leaders' answers don't reach all links, so that later rounds decide."""
    chain = prose(78, 400).split()
    texts = [" ".join([*chain[:300], *(f"v{i}x{k}" for k in range(i % 7))]) for i in range(30)]
    texts += [" ".join(chain[i : i + 290]) for i in range(0, 40, 4)]
    got = jaccard.linked(docs(spark, texts), 3, 90, 100).orderBy("doc_id").select("n_shingles", "component_id").collect()
    assert [tuple(x) for x in got] == slow_groups(texts, 3, 90, 100)


def test_groups_edges(edges, empty):
    got = check(jaccard.linked(edges), edges).toPandas()
    assert set(got.loc[got.doc_id.isin([1, 2, 10]), "component_id"]) == {1}
    once = jaccard.deduplicated(edges)
    assert once.columns == edges.columns
    assert sorted(x.doc_id for x in once.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 11]
    assert jaccard.linked(empty).isEmpty() and jaccard.deduplicated(empty).isEmpty()


# --- top-k


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = r.integers(-2, 3, (400, 4)) / 4.0  # many ties
    table = [(i * 5, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(7, None), (9, [1.0, None, 0.0, 0.0]), (11, [float("nan")] * 4), (None, [0.0] * 4), (13, [1.0])]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    q = np.floor(vectors * 1024).astype(int)
    want = {}
    for i in range(0, 400, 20):
        scores = sorted((-int(s), k * 5) for k, s in enumerate(q @ q[i]) if k != i)[:10]
        want[i * 5] = [(k, -s) for s, k in scores]
    frame = frame.unionByName(frame.filter("vec_id = 100"))  # a repeated query row, which is also a repeated candidate
    for q_id, found in want.items():
        again = [x for x in found if x[0] == 100]
        want[q_id] = sorted(found + again, key=lambda x: (-x[1], x[0]))[:10]
    for options in ({}, {"bins": 5}, {"block_size": 3}):
        got = collections.defaultdict(list)
        for x in topk.top_k(frame, **options).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.vec_id, x.score))
        assert got == want
        assert topk.ROUNDS[0] >= 0 and topk.ROUNDS[-1] == 0  # histograms ran until every k-th value was known
    assert topk.top_k(frame.limit(0)).isEmpty()


def test_histograms_find_each_kth_value(spark):
    topk.top_k(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), bins=16).count()
    assert len(topk.ROUNDS) >= 3 and topk.ROUNDS[0] > 0 and topk.ROUNDS[-1] == 0


def test_topk_of_queries_of_two_lengths_and_of_large_components(spark):
    table = [(0, [1.0, 2.0]), (100, [1.0]), (1, [3.0]), (2, [1.0, 1.0]), (3, [2.0**20, -(2.0**20)]), (200, [2.0**20, 2.0**20])]
    got = topk.top_k(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    want = collections.defaultdict(list)
    for a, x in table:
        for b, y in table:
            if a % 100 == 0 and a != b and len(x) == len(y):
                want[a].append((-sum(int(i * 1024) * int(j * 1024) for i, j in zip(x, y, strict=True)), b))
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {(a, i + 1, b, -s) for a, found in want.items() for i, (s, b) in enumerate(sorted(found))}
    large = spark.createDataFrame([(0, [1e20, 1.0]), (1, [1e20, -1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        topk.top_k(large).collect()


# --- suffix arrays


def test_suffix_array():
    r = random.Random(6)
    for _ in range(400):
        t = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 50))] + [0]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def slow_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = {k for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1 for k in range(i, i + length)}
        spans = sum(k - 1 not in gone for k in gone)
        out.append((len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone)))
    return out


def test_byte_dedup_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    passage = prose(50, 60)
    texts = [prose(i, 80) + passage[r.randint(0, 40) : 300] + prose(i + 100, 30) for i in range(12)] + near_copies(3, prose(51, 200), 8, 3)
    texts += ["ab" * 300, prose(60, 60) * 2, "é" * 250, None, "", "short"] + [prose(61, 90)] * 2
    want = slow_bytes(texts, 200)
    for most in (2000, 1):  # by suffix arrays; by counts
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        got = suffix_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()
        assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got] == want


def test_runs_are_sliced(monkeypatch):
    text = prose(70, 400)
    for size in (1 << 22, 256, 301):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        parts = list(suffix_dedup.records(text, 200))
        windows = sorted(w for *_, first, extent in parts for f, e in zip(first, extent, strict=True) for w in range(f, f + (e >> 9) + 1))
        assert windows == list(range(len(text.encode()) - 199)) and (len(parts) > 1) == (size < 1000)


def test_words_that_collide_in_polynomial_hashes_stay(spark):
    word = thue_morse(2048)
    texts = [word[:1024], word[1024:].translate(str.maketrans("ab", "ba"))[::-1], word[:1024].translate(str.maketrans("ab", "ba"))]
    got = suffix_dedup.dedup(docs(spark, texts), 500).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got] == slow_bytes(texts, 500)


def test_byte_dedup_edges(edges, empty):
    got = check(suffix_dedup.dedup(edges), edges).toPandas()
    assert (got[got.doc_id.isin([1, 2])].n_removed == got[got.doc_id.isin([1, 2])].n_bytes).all()
    assert got.loc[got.doc_id == 3, "n_bytes"].item() == 0
    assert suffix_dedup.dedup(empty).isEmpty()


# --- queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_sql(spark, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(queries.ORACLE_SQL[name]).df()
    assert rows(ours) == rows(theirs)


def test_op9_on_the_table(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = [(d.doc_id, *w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(given, slow_bytes([d.text for d in given], 200), strict=True)]
    assert [tuple(x) for x in queries.op9_suffix_dedup(spark, SF).orderBy("doc_id").collect()] == want


def wanted_copies(given):
    """What mix() takes of whole documents, one source after the other."""
    sizes, out = collections.Counter(), {}
    for r in given:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = shares(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    for s in order:
        epochs, start = int(target[s] // sizes[s]) if sizes[s] else 0, 0
        for r in sorted((r for r in given if r.source == s), key=lambda r: (r.key, r.doc_id)):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            out[r.doc_id] = (epochs + (start + n / 2 <= target[s] - epochs * sizes[s])) if n else 0
            start += n
    return {k: v for k, v in out.items() if v}


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept."""
    import duckdb
    import tiktoken

    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    held = {"": spark.read.parquet(f"{SF}/documents.parquet").cache()}
    for name, stage in corpus_pipeline.STAGES:
        held[name] = stage(spark, held[list(held)[-1]], SF).cache()
    first, second, third, fourth, fifth = (held[n].collect() for n in stages)
    given = held[""].collect()

    ids = lambda rows: {r.doc_id for r in rows}
    base = {r.doc_id for r in given if (lambda x: x[0] >= 10 and 100 * x[4] <= 20 * x[0])(slow_stats(r.text or ""))}
    judged = {r.doc_id: r for r in kneser_ney.rules(held[""]).collect()}
    assert ids(first) == {i for i in base if judged[i].surprise is None or judged[i].low <= judged[i].surprise <= judged[i].high}

    con = duckdb.connect()
    con.register("documents", held["quality rules"].toPandas())
    cleaned = {r[0]: r[1] for r in con.sql(queries.LINES_SQL.replace("sha256(", "(")).select("doc_id, kept_sha256").fetchall()}
    assert {r.doc_id: r.text for r in second} == {i: t for i, t in cleaned.items() if re.search(r"[^\x20\x09-\x0D]", t)}

    order = sorted(second, key=lambda r: r.doc_id)
    groups = slow_groups([r.text for r in order], 5, 80, 100)
    assert ids(third) == {r.doc_id for i, (r, (_, c)) in enumerate(zip(order, groups, strict=True)) if c == i}

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = held["n-gram Jaccard join"].withColumn("key", -F.log(u) / mixing.quality_weight(F.col("text"))).collect()
    assert collections.Counter(r.doc_id for r in fourth) == wanted_copies(keyed)

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    want = collections.Counter((r.doc_id, np.array(other.encode_ordinary(r.text), "<u4").tobytes(), True) for r in fourth)
    assert collections.Counter((r.doc_id, bytes(r.ids), r.round_trip) for r in fifth) == want


def test_pipeline(spark, edges):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == given.columns and not out.isEmpty()
        assert stage(spark, edges, SF).columns == edges.columns and stage(spark, edges.limit(0), SF).isEmpty()
    final = corpus_pipeline.run(spark, SF)
    assert final.filter("NOT round_trip").isEmpty() and final.count() > 50
    assert set(CLASHES) <= set(edges.columns)
