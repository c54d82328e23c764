"""Licence scans by a positional rare-token index, in DataFrame functions only.

Every template is a run of words. Over all documents Spark counts in how many each template word stands, and each
template's ``RARE`` words of the highest IDF go into the index with their positions in the template: the postings. A file
looks up all its places of indexed words; a place less the word's position is where the template would begin. Such a
beginning stays if at least two of the template's rare words (or its only one) stand at their relative positions. Then the
share of template words in place and the mandatory key phrase at its place are verified on the file's words.

Base templates are short phrases; all their words must be in place, and all such places are counted.

Defined results: null texts are empty; a text without words has no places, labels or score; every place of a text of any
length is looked up, however often a word repeats; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licences, their labels, and the key phrase that must stand in its place.
NOTICES = [
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl-notice", "under the terms of the gnu general public license", "general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("cc-by-4.0", "creative commons attribution 4 0 international", "creative commons attribution"),
    ("cc0", "creative commons zero public domain dedication", "public domain dedication"),
    ("unlicense", "free and unencumbered software released into the public domain", "released into the public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
#: Rare words of a template in the index.
RARE = 3
#: Share of a notice's words that must be in place.
COVER = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # first word and number of words of the key phrase
    base: bool


def templates() -> list[Template]:
    out = [Template(label, tuple(p.split()), (0, len(p.split())), True) for p, label in BASE.items()]
    for label, text, key in NOTICES:
        words, inner = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(inner)] == inner)
        out.append(Template(label, tuple(words), (at, len(inner)), False))
    return out


def pieces(text: Column) -> Column:
    """The words of a text, with an empty piece at either end where the text doesn't begin or end with a word.

    Words are runs of anything but ASCII marks and blanks. Lower-casing reaches beyond A-Z, which no template can tell:
    no letter outside ASCII becomes an ASCII letter of a template, and no word is cut or joined by it.
    """
    return F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def idf(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """The IDF of the vocabulary's words over all documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(F.array_intersect(pieces(text), F.array(*map(F.lit, vocabulary))).alias("w"))
    counts = held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places, notices) for every document.

    places: array<struct<label, at>> of the base phrases; notices: array<struct<label, at, cover>> of the verified notices.
    """
    wanted = templates()
    weight = idf(docs, sorted({w for t in wanted for w in t.words}), text_col)
    rare = [sorted(range(len(t.words)), key=lambda i, t=t: (-weight[t.words[i]], i))[:RARE] for t in wanted]
    index = sorted({t.words[i] for t, at in zip(wanted, rare) for i in at})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("scan_id"), pieces(text).alias("cut"))
    cut, none = F.col("cut"), F.array().cast("array<string>")
    ends = (F.element_at(cut, 1) == "").cast("int") + ((F.size(cut) > 1) & (F.element_at(cut, -1) == "")).cast("int")
    found = F.arrays_overlap(cut, F.array(*map(F.lit, index)))
    rows = rows.select("scan_id", (F.size(cut) - ends).alias("n"), F.when(found, F.filter(cut, lambda w: w != "")).otherwise(none).alias("words"))
    some = F.size("words") > 0
    hit = F.filter(F.transform("words", lambda w, i: F.when(w.isin(index), i)), lambda i: i.isNotNull())
    rows = rows.select("*", F.when(some, hit).otherwise(F.array().cast("array<int>")).alias("hits"))
    words, hits, n = F.col("words"), F.col("hits"), F.col("n")

    def beginnings(t: Template, at: list[int]) -> Column:
        """Where at least two of the rare words stand in their relative positions, and the whole template fits."""

        def posting(j: int) -> Column:
            return F.transform(F.filter(hits, lambda i: F.get(words, i) == t.words[j]), lambda i: i - j)

        need = min(2, len(at))

        def aligned(s: Column) -> Column:
            votes = sum((F.when(F.get(words, s + j) == t.words[j], 1).otherwise(0) for j in at), F.lit(0))
            return (s >= 0) & (s + len(t.words) <= n) & (votes >= need)

        return F.filter(F.array_distinct(F.concat(*map(posting, at))), aligned)

    def cover(t: Template, s: Column) -> Column:
        return sum((F.when(F.get(words, s + j) == w, 1.0).otherwise(0.0) for j, w in enumerate(t.words)), F.lit(0.0)) / len(t.words)

    def key_there(t: Template, s: Column) -> Column:
        a, k = t.key
        return F.array_join(F.slice(words, s + a + 1, F.lit(k)), " ") == " ".join(t.words[a : a + k])

    def places(t: Template, at: list[int]) -> Column:
        """The verified places of a template."""
        found = F.filter(beginnings(t, at), lambda s: key_there(t, s))
        if t.base:
            return F.transform(found, lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("at")))
        seen = F.transform(found, lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("at"), cover(t, s).alias("cover")))
        return F.filter(seen, lambda x: x["cover"] >= COVER)

    base = [places(t, at) for t, at in zip(wanted, rare) if t.base]
    more = [places(t, at) for t, at in zip(wanted, rare) if not t.base]
    return rows.select(
        F.col("scan_id").alias(id_col),
        n.cast("long").alias("n_words"),
        F.when(some, F.concat(*base)).otherwise(F.array().cast("array<struct<label:string,at:int>>")).alias("places"),
        F.when(some, F.concat(*more)).otherwise(F.array().cast("array<struct<label:string,at:int,cover:double>>")).alias("notices"),
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_base, first_word, last_word, base_labels, labels and score of scanned documents."""
    starts = F.transform("places", lambda p: p["at"])
    labels = lambda c: F.array_distinct(F.transform(c, lambda p: p["label"]))
    score = F.coalesce(F.array_max(F.transform("notices", lambda x: x["cover"])), F.when(F.size("places") > 0, 0.5), F.lit(0.0))
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels("places")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels("places"), labels("notices"))), ",").alias("labels"),
        score.alias("score"),
    )
