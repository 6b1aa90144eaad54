"""Licence scan with a positional rare-token index.

Every template is a licence statement as words, with a key phrase that must be there. The index keeps, per
template, the key phrase's ``RARE`` words of highest inverse document frequency over all documents, with
their places in the statement.
In a document the places of those words, less their places in the template, are the starts at which the
template could stand; the starts of all its rare words are intersected, and at what is left the key phrase
must stand word for word. The score is the share of the template's words found in place.

Words are runs of ASCII letters and digits and of all characters above ASCII, with A-Z in lower case. Beside
the templates, fixed phrases are counted wherever their words follow each other.

Nulls: a null text has no words, no labels and score 0. Very long texts cost one pass; only places of
licence words are kept. A column named ``licence`` is replaced, others pass through untouched. Repeated rows get the same answer. An empty table gives an empty result. Only
built-in functions are used and nothing is shuffled but one count per licence word and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionledger.llm.common import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3

# fixed values: label, statement, key phrase
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


def words_of(text: Column) -> Column:
    # of all capitals outside ASCII only these two turn into ASCII letters
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.array_remove(F.split(F.lower(t), SEPARATORS), "")


def word_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of a bounded vocabulary stands, over all documents."""
    own = F.filter(words_of(F.col(text)), lambda w: w.isin(vocabulary))
    codes = F.array_distinct(F.transform(own, lambda w: F.array_position(F.array(*map(F.lit, vocabulary)), w)))
    counted = docs.select(F.explode(codes).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    found = {int(r["c"]): int(r["n"]) for r in counted.collect()}  # one row per vocabulary word
    return {w: found.get(i + 1, 0) for i, w in enumerate(vocabulary)}


def rare_places(statement: list[str], key: list[str], idf: dict[str, float]) -> list[tuple[str, int]]:
    """The key phrase's words of highest idf with their first places in the statement."""
    at = key_place(statement, key)
    order = sorted(set(key), key=lambda w: (-idf[w], w))
    return [(w, at + key.index(w)) for w in order[:RARE]]


def key_place(statement: list[str], key: list[str]) -> int:
    return next(i for i in range(len(statement)) if statement[i:i + len(key)] == key)


def _standing(words: Column, start: Column, phrase: list[str], least: int = 0) -> Column:
    """The phrase stands at ``start``."""
    return (start >= least) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, len(phrase)) == F.array(*map(F.lit, phrase)))


def _starts(hits: Column, rare: list[tuple[str, int]]) -> Column:
    """Starts at which all rare words are in place."""

    def shifted(word: str, at: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - at)

    out = shifted(*rare[0])
    for word, at in rare[1:]:
        out = F.array_intersect(out, shifted(word, at))
    return F.array_distinct(out)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``licence``: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    statements = [(label, s.split(), key.split()) for label, s, key in TEMPLATES]
    vocabulary = sorted({w for _, s, _ in statements for w in s})
    n = docs.count()
    idf = {w: math.log((1 + n) / (1 + c)) for w, c in word_counts(docs, vocabulary, text).items()}
    index = [(label, s, key, rare_places(s, key, idf)) for label, s, key in statements]
    wanted = sorted({w for *_, rare in index for w, _ in rare} | {p.split()[0] for _, p in BASE})

    own = [c for c in docs.columns if c != "licence"]
    split = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("d"), F.inline(F.array(F.struct(words_of(F.col(text)).alias("w")))))
    words = F.col("w")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(wanted))
    found = split.select("d", "w", F.inline(F.array(F.struct(hits.alias("hits")))))

    def base(phrase: str) -> Column:
        p = phrase.split()
        return F.transform(F.filter("hits", lambda h: (h["w"] == p[0]) & _standing(words, h["i"], p)), lambda h: h["i"])

    def template(statement: list[str], key: list[str], rare: list[tuple[str, int]]) -> Column:
        """Best share of the statement in place over the starts where the key phrase stands; null if there is none."""
        at = key_place(statement, key)
        starts = F.filter(_starts(F.col("hits"), rare), lambda s: _standing(words, s + at, key))

        def share(s: Column) -> Column:
            same = [F.coalesce((F.get(words, s + i) == w), F.lit(False)).cast("int") for i, w in enumerate(statement)]
            return sum(same[1:], same[0]) / len(statement)

        return F.array_max(F.transform(starts, share))

    some = F.size("hits") > 0
    none = F.array().cast("array<int>")
    marks = F.struct(
        *(F.when(some, base(p)).otherwise(none).alias(f"b{i}") for i, (_, p) in enumerate(BASE)),
        *(F.when(some, template(s, k, r)).alias(f"t{i}") for i, (_, s, k, r) in enumerate(index)))
    scored = found.select("d", F.size("w").cast("long").alias("n_words"), F.inline(F.array(marks)))
    places = F.concat(*(F.col(f"b{i}") for i in range(len(BASE))))
    base_labels = [F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE)]
    more = [F.when(F.col(f"t{i}").isNotNull(), F.lit(label)) for i, (label, *_) in enumerate(index)]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    best = F.greatest(*(F.coalesce(F.col(f"t{i}"), F.lit(0.0)) for i in range(len(index))), F.when(F.size(places) > 0, 0.5).otherwise(0.0))
    return scored.select(*(F.col("d")[c].alias(c) for c in own), F.struct(
        "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(base_labels + more).alias("labels"), best.alias("score")).alias("licence"))
