"""Licence scans against templates slid along every text, and on edge cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.llm import licenses
from paceline.llm.licenses import BASE, LICENCES, Template, plain_words, prepared, scan


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in lowered).split(" ")


def slid(text, templates, share):
    """Every (label, start, matched, base) at which enough words and all key words are in place."""
    ws, out = [w for w in words_of(text) if w], []
    for t in templates:
        tw = plain_words(t.text)
        key = set()
        for phrase in map(plain_words, t.key):
            at = next(i for i in range(len(tw)) if tw[i : i + len(phrase)] == phrase)
            key |= set(range(at, at + len(phrase)))
        need = len(tw) if t.base else math.ceil(share * len(tw) - 1e-9)
        for s in range(-len(tw), len(ws)):
            same = [0 <= s + i < len(ws) and ws[s + i] == w for i, w in enumerate(tw)]
            if sum(same) >= need and all(same[i] for i in key):
                out.append((t.label, s, len(tw), sum(same), t.base))
    return sorted(out)


def got_places(frame, templates=BASE + LICENCES, share=0.8):
    return {r.doc_id: sorted(tuple(p) for p in r.places) for r in scan(frame, templates, share).collect()}


def mangled(seed):
    """Texts of licence passages with words changed, dropped and repeated, among other licence words."""
    r = random.Random(seed)
    pool = [w for t in BASE + LICENCES for w in plain_words(t.text)]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(r.randint(0, 4)):
            ws = plain_words(r.choice(BASE + LICENCES).text)
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(ws))
                ws[i : i + 1] = r.choice([[r.choice(pool)], [], ["straße"], [ws[i], ws[i]]])
                ws = ws or ["x"]
            parts += ws + [r.choice(pool) for _ in range(r.randint(0, 5))]
        out.append("".join(w.upper() + "-" if r.random() < 0.3 else w + r.choice([" ", "\n", ", ", "\u0000"]) for w in parts))
    return out


@pytest.mark.parametrize("share", [0.8, 0.9, 1.0])
def test_against_sliding(spark, share):
    texts = mangled(int(share * 10)) + ["all rights reserved all rights reserved", "CC-BY cc by CC BY", "general public license " * 50, "license " * 500]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got_places(frame, share=share) == {i: slid(t, BASE + LICENCES, share) for i, t in enumerate(texts)}
    assert sum(map(bool, got_places(frame, share=share).values())) > 10


def test_random_templates(spark):
    """A small alphabet, so that words repeat within templates and texts."""
    r = random.Random(5)
    templates = []
    while len(templates) < 12:
        ws = [r.choice("abcdefghijkl") for _ in range(r.randint(3, 14))]
        t = Template(f"t{len(templates)}", " ".join(ws), (" ".join(ws[1:3]),))
        try:
            prepared(t, 0.8)
        except ValueError:
            continue
        templates.append(t)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(200)) for _ in range(30)] + [t.text + " a b c " + t.text for t in templates]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got_places(frame, tuple(templates)) == {i: slid(t, templates, 0.8) for i, t in enumerate(texts)}


def test_templates_are_refused_that_could_be_missed():
    with pytest.raises(ValueError, match="too few"):
        prepared(Template("x", "a a a a a a a a a a", ("a",)), 0.8)
    with pytest.raises(ValueError, match="key phrase"):
        prepared(Template("x", "one two three", ("four",)), 0.8)


def test_edges(edges, empty):
    got = scan(edges.withColumn("places", F.lit("x")))
    assert got.count() == edges.count() and len(got.columns) == len(set(got.columns)) and set(edges.columns) < set(got.columns)
    of = {r.doc_id: r for r in got.collect()}
    for i in (3, 4, 6):
        assert (of[i].n_words, of[i].n_base, of[i].first_word, of[i].labels, of[i].base_labels, of[i].score) == (0, 0, None, "", "", 0.0)
    assert of[5].n_words == 30_000 and of[7].n_words == 1
    assert scan(empty).isEmpty()


def test_digest(spark):
    frame = spark.createDataFrame([(1, "x All rights reserved. y, all RIGHTS-reserved\nReleased under the MIT license"), (2, "K ccK by"), (1, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in scan(frame).select("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())
    assert got[-1] == (13, 2, 1, 5, "reserved", "mit,reserved", 1.0)
    assert [g[1] for g in got[:2]] == [0, 0] and [g[0] for g in got[:2]] == [0, 3]


def test_frequencies_choose_the_lookup(spark):
    """The rarest words of the corpus come first; equally frequent ones by name."""
    frame = spark.createDataFrame([("a b c",), ("a b",), ("a a",)], "text string").select(licenses.words_of(F.col("text")).alias("w"))
    df = licenses.frequencies(frame, ["a", "b", "c", "d"])
    assert df == {"a": 3, "b": 2, "c": 1}
    [entry] = frame.limit(1).select(licenses.index([prepared(Template("t", "a b c d", ("a",)), 1.0)], df).alias("i")).first().i
    assert entry.ranked == ["d", "c", "b", "a"]
