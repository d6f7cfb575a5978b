"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A document's words are dealt in blocks of BLOCK words, or twice the longest template's, that overlap by half. A block meets a template if it
contains at least CONTAINED of the template's distinct words. All template words are ranked by how many documents
of the corpus have them, the rarest first. With n words and o = ceil(CONTAINED * n) needed, a block that meets the
template has one of its n - o + 1 rarest words (prefix filter), has at least o template words (length filter) and
has enough words left after the first common one (positional filter); what passes is counted exactly. The
templates are a short fixed table, so their index travels in the plan and documents are not shuffled. Only
built-in functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import source_columns

#: (phrase, label): fixed values of the base scan.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: (label, notice): the usual short notices of licenses.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]

CONTAINED = 0.9
#: Words in a block at least; it has twice the words of the longest template if that is more, as blocks overlap by half.
BLOCK = 80

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of a text in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case first."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS, -1)
    return F.filter(pieces, lambda w: w != "")


def notice_words(notice: str) -> list[str]:
    """Words of a notice, by the rule of words_of."""
    plain = "".join(c.lower() if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in notice)
    return plain.split()


def template_words(notice: str) -> list[str]:
    """Distinct words of a notice."""
    return sorted(set(notice_words(notice)))


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.expr("cast(array() as array<string>)")


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, words of the fewest documents first; equals by name. One row a word comes to the driver."""
    had = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), strings(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in had.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Numbers of the words at which a phrase stands."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(parts)))
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when((F.size(words) >= len(parts)) & F.array_contains(words, parts[-1]), spots).otherwise(F.expr("cast(array() as array<int>)"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    contained: float = CONTAINED,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, met of every whole text.

    n_base counts the places of all phrases, first_word and last_word are the smallest and largest start (null if
    none), base_labels their labels. met lists (template label, first word of the block, share) of each block and
    template that meet; labels also has the labels of the templates, and score is the largest share in met, else
    0. Labels are distinct, sorted and joined by commas. A null text counts as empty and has no words. Repeated
    rows and null ids stay; other columns are not looked at.
    """
    rows = source_columns(docs, doc_id=id_col, text=text_col)
    sets = [(label, template_words(notice)) for label, notice in templates]
    order = word_order(rows, sorted({w for _, ws in sets for w in ws}))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for label, ws in sets:
        ranks = sorted(rank[w] for w in ws)
        need = math.ceil(contained * len(ranks) - 1e-9)
        index.append((label, ranks, need, ranks[: len(ranks) - need + 1]))
    rare = sorted({r for *_, prefix in index for r in prefix})
    ints = lambda values: F.array(*(F.lit(v) for v in values))
    table = F.array(*(F.struct(F.lit(label).alias("label"), ints(ranks).alias("ranks"), F.lit(need).alias("need"), ints(prefix).alias("prefix")) for label, ranks, need, prefix in index))
    half = max(block // 2, *(len(notice_words(notice)) for _, notice in templates), 1)

    out = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    out = out.withColumn("hot", F.arrays_overlap("words", strings([order[r] for r in rare])))
    places = F.when(F.array_contains("words", "license") | F.lit(any("license" not in p for p, _ in phrases)), F.array(*(phrase_starts(F.col("words"), p) for p, _ in phrases)))
    out = out.withColumn("places", places)
    # what stands in the template vocabulary: half-block number and rank
    ranked = F.transform("words", lambda w, i: F.struct(F.floor(i / half).cast("int").alias("at"), (F.array_position(strings(order), w) - 1).cast("int").alias("rank")))
    out = out.withColumn("hits", F.when(F.col("hot"), F.filter(ranked, lambda h: h["rank"] >= 0)))
    starts = F.flatten(F.transform(F.filter("hits", lambda h: F.array_contains(ints(rare), h["rank"])), lambda h: F.array(h["at"] - 1, h["at"])))
    out = out.withColumn("starts", F.array_distinct(F.filter(starts, lambda a: a >= 0)))
    blocks = F.transform("starts", lambda a: F.struct(a.alias("at"), F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: (h["at"] == a) | (h["at"] == a + 1)), lambda h: h["rank"]))).alias("ranks")))
    out = out.withColumn("blocks", blocks)

    def candidates(b: Column) -> Column:
        def passes(t: Column) -> Column:
            first = F.element_at(F.array_intersect(t["ranks"], b["ranks"]), 1)  # both are in rank order
            left = F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], first), F.size(b["ranks"]) - F.array_position(b["ranks"], first)) + 1
            return (F.size(b["ranks"]) >= t["need"]) & F.arrays_overlap(t["prefix"], b["ranks"]) & (left >= t["need"])

        return F.transform(
            F.filter(table, passes),
            lambda t: F.struct(t["label"].alias("label"), (b["at"] * half).alias("word"), F.size(F.array_intersect(t["ranks"], b["ranks"])).alias("common"), t["need"].alias("need"), F.size(t["ranks"]).alias("n")),
        )

    met = F.filter(F.flatten(F.transform("blocks", candidates)), lambda m: m["common"] >= m["need"])
    met = F.transform(met, lambda m: F.struct(m["label"].alias("label"), m["word"].alias("word"), (m["common"] / m["n"]).alias("share")))
    out = out.withColumn("met", F.coalesce(met, F.expr("cast(array() as array<struct<label: string, word: int, share: double>>)")))
    every = F.coalesce(F.flatten("places"), F.expr("cast(array() as array<int>)"))
    found = F.array(*(F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)))
    base = F.array_distinct(F.array_compact(found))
    return out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("met", lambda m: m["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("met", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        "met",
    )
