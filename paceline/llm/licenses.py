"""Scans for licence texts by a positional index of rare words.

Templates are passages of licences, each with a label and the words of its mandatory key phrase. A place of a template in a
document is a shift at which at least `share` of the template's words stand where the template has them, all words of
its key phrase among them. Places are found without sliding templates along texts:

1. Document frequencies of the licence words (those of any template, a bounded set) are counted over all documents.
2. A document's licence words follow from one intersection. A template of n words, d of them distinct, of which
   m = n - ceil(share * n) may be out of place, needs at least d - m of them in the document.
3. Of each template that is left, the document's m + 2 licence words of highest inverse document frequency are looked
   up: wherever the template is, two of their places at least agree on its shift. Postings of the template are
   intersected by relative position, that is, shifts that occur twice are kept.
4. Shifts are verified word by word, key phrase first.

So the index loses no place. Base phrases are templates all of whose words are key words. A template may stand at
several places, and places of different templates may overlap.

Everything is Spark's own functions on one row at a time; the only shuffle is that of the counts of licence words. A
row's work grows with its licence words, not with the product of text and templates.

Defined cases: null and empty texts have no words and no labels. Rows that are equal, or share an id, are scanned each
for itself. Whatever other columns the table has come back unchanged but for those named like the results. An empty
table gives an empty result. Long texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import aside, restored

#: What stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased words; only A-Z have another case. lower() is faster and the same on ASCII."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def plain_words(text: str) -> list[str]:
    """words_of for templates, which are ASCII."""
    return [w for w in re.split(BETWEEN, text.lower()) if w]


class Template(NamedTuple):
    """A passage to look for. key: phrases of the text that must stand word for word; base ones are counted apart."""

    label: str
    text: str
    key: tuple[str, ...]
    base: bool = False


#: Phrases and labels of the contract. Fixed values.
BASE = tuple(Template(label, phrase, (phrase,), True) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")))

#: Passages of public licences and the usual lines that name them. Fixed values.
LICENCES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License", "2.0")),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache.org", "LICENSE-2.0")),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("Apache-2.0",)),
    Template("mit", "Released under the MIT License", ("MIT License",)),
    Template("mit", "Licensed under the MIT License", ("MIT License",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("Identifier: MIT",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("hereby granted, free of charge", "without restriction")),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("General Public License", "version 2")),
    Template("gpl-2.0", "SPDX-License-Identifier: GPL-2.0", ("GPL-2.0",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("GNU General Public License", "version 3")),
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("General Public License", "version 3")),
    Template("gpl-3.0", "SPDX-License-Identifier: GPL-3.0", ("GPL-3.0",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("Lesser General Public License",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("Affero General Public License",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    Template("bsd", "Released under the BSD License", ("BSD License",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License", "2.0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    Template("cc0", "dedicated to the public domain under the CC0 1.0 Universal", ("CC0 1.0",)),
    Template("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential", ("Unauthorized copying", "strictly prohibited")),
)


@dataclass(frozen=True)
class Prepared:
    """A template's words, the positions of its key phrases, and what follows from share."""

    template: Template
    words: list[str]
    key: list[int]
    least: int  # words in place

    @property
    def spare(self) -> int:
        return len(self.words) - self.least

    @property
    def distinct(self) -> list[str]:
        return sorted(set(self.words))


def prepared(t: Template, share: float) -> Prepared:
    words = plain_words(t.text)
    key: set[int] = set()
    for phrase in map(plain_words, t.key):
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        if not at:
            raise ValueError(f"key phrase {' '.join(phrase)!r} is not in its template")
        key.update(range(at[0], at[0] + len(phrase)))
    least = len(words) if t.base else math.ceil(share * len(words) - 1e-9)
    p = Prepared(t, words, sorted(key), least)
    # two of the looked-up words must agree wherever the template is
    if len(p.distinct) - p.spare < p.spare + 2:
        raise ValueError(f"template {t.text!r} has too few distinct words for a share of {share}")
    return p


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the vocabulary occurs. words: a column w of arrays."""
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("w"))
    counts = words.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r.word: r.n for r in counts.collect()}  # as many rows as licence words at most


INDEX = "array<struct<label string, words array<string>, ranked array<string>, key array<int>, least int, spare int, base boolean, postings array<struct<w string, p int>>>>"


def index(templates: list[Prepared], df: dict[str, int]) -> Column:
    """The templates with their postings as one constant; words by falling inverse document frequency, ties by word."""
    rank = lambda w: (df.get(w, 0), w)
    entries = [
        {"label": t.template.label, "words": t.words, "ranked": sorted(set(t.words), key=rank), "key": t.key, "least": t.least, "spare": t.spare, "base": t.template.base, "postings": [{"w": w, "p": i} for i, w in enumerate(t.words)]}
        for t in templates
    ]
    return F.from_json(F.lit(json.dumps(entries)), INDEX)


def places(words: Column, present: Column, licence_words: Column, templates: Column) -> Column:
    """array<struct<label, start, n, matched, base>>: all verified places in one text.

    present: the licence words that occur in it; licence_words: array<struct<w, i>>, their positions.
    """

    def shifts(t: Column) -> Column:
        rare = F.slice(F.array_intersect(t["ranked"], present), 1, t["spare"] + 2)
        hits = F.filter(licence_words, lambda x: F.array_contains(rare, x["w"]))
        votes = F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(F.filter(t["postings"], lambda p: p["w"] == x["w"]), lambda p: x["i"] - p["p"]))))
        # the second vote of each shift: the same as the one before it, but not as that before
        second = F.filter(F.transform(votes, lambda v, k: F.struct(v.alias("v"), ((F.get(votes, k - 1) == v) & ~F.coalesce(F.get(votes, k - 2) == v, F.lit(False))).alias("second"))), lambda x: x["second"])
        return F.transform(second, lambda x: x["v"])

    def verified(t: Column, shift: Column) -> Column:
        in_place = lambda p: F.coalesce(F.get(words, shift + p) == F.get(t["words"], p), F.lit(False))
        matched = F.size(F.filter(t["postings"], lambda q: in_place(q["p"])))
        return F.struct(t["label"].alias("label"), shift.alias("start"), F.size(t["words"]).alias("n"), F.when(F.forall(t["key"], in_place), matched).otherwise(0).alias("matched"), t["base"].alias("base"), (matched >= t["least"]).alias("enough"))

    possible = F.filter(templates, lambda t: F.size(F.array_intersect(t["ranked"], present)) >= F.size(t["ranked"]) - t["spare"])
    found = F.flatten(F.transform(possible, lambda t: F.transform(shifts(t), lambda s: verified(t, s))))
    return F.transform(F.filter(found, lambda x: x["enough"] & (x["matched"] > 0)), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["n"].alias("n"), x["matched"].alias("matched"), x["base"].alias("base")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + LICENCES, share: float = 0.8, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and places.

    n_base counts the places of base templates, first_word and last_word are the least and largest start of these (from 0,
    null without any). Labels are distinct, sorted and joined by commas; labels holds those of all places, base_labels
    those of base ones. score is the largest share of a template's words in place, 0 without a place. places is an array of
    (label, start, n, matched, base); start is below 0 where a passage's first words are cut off.
    """
    known = [prepared(t, share) for t in templates]
    vocabulary = sorted({w for t in known for w in t.words})
    given, names = aside(docs)
    worded = given.withColumn("w", words_of(F.col(names[text])))
    df = frequencies(worded.select("w"), vocabulary)
    ready = worded.withColumn("present", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("w")))
    own = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*vocabulary))
    ready = ready.withColumn("hits", F.when(F.size("present") > 1, own).otherwise(F.slice(own, 1, 0)))
    found = ready.withColumn("places", places(F.col("w"), F.col("present"), F.col("hits"), index(known, df)))
    of_base = F.filter("places", lambda x: x["base"])
    starts = F.transform(of_base, lambda x: x["start"].cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return restored(
        found, names, n_words=F.size("w").cast("long"), n_base=F.size(of_base).cast("long"), first_word=F.array_min(starts), last_word=F.array_max(starts),
        base_labels=joined(of_base), labels=joined(F.col("places")), score=F.coalesce(F.array_max(F.transform("places", lambda x: x["matched"] / x["n"])), F.lit(0.0)), places=F.col("places"),
    )
