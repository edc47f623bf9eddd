from __future__ import annotations

import random

import pytest

WORDS = ["the", "of", "and", "river", "stone", "quick", "Brown", "tree", "light", "écho", "straße", "ночь", "vast", "cold", "sing", "walk"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgiklmnoprstuvw") for _ in range(r.randint(2, 8))) if r.random() < 0.7 else r.choice(WORDS) for _ in range(n)]
    return "".join(w + ("\n" if i % 9 == 8 else " ") for i, w in enumerate(words))


#: Columns whose names operators use themselves.
CLASHES = ("size", "shard", "score", "kept", "copies", "rid", "in_0", "bucket", "n_words", "component_id", "label")


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a"), (2, prose(2, 120), "en", "a"), (3, None, "en", None), (4, "", None, "b"), (None, prose(3, 60), "de", "b"),
        (5, long, "de", "a"), (6, " \n\t ", "de", "c"), (7, "one", "en", "c"), (8, "1234 !!", "en", "c"), (9, prose(4, 90), None, None), (9, prose(4, 90), None, None),
        (10, prose(2, 120) + "extra words here", "en", "a"), (11, "😀 ퟿ \u0000 end", "en", "b"), (None, None, None, None),
    ]
    rows = [(*r, len(r[1] or ""), *(f"x{i}" for i in range(len(CLASHES)))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
