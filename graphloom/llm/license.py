"""License scan: exact containment join of text blocks against license templates, on DataFrame functions only.

A block is a line, or a run of as many consecutive words as the template has, over any line breaks and
comment marks, so that wrapped notices are met, each time that they stand in a text. A template's distinct words are ordered by how many
documents hold them, rarest first, over the whole input. A block that holds at least ``threshold`` of them must hold one of the
first |T| - need + 1 (prefix filter), have at least ``need`` distinct words (length filter), and meet
its first template word early enough for ``need`` to remain (positional filter); only then is the
overlap counted, for lines and for runs. The templates
are a parameter of bounded size, so their words are literals in the plan: texts are scanned where they lie and never shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-cased words: ASCII digits and letters, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

KIND = "array<struct<block:int,label:string,containment:double,first:int,end:int>>"

#: Lines whose words are summed at once.
CHUNK = 256

# Phrases with their labels, and license notices with theirs.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def lowered(text: Column) -> Column:
    """A-Z as a-z and nothing else. lower() does the same, but for two letters that it turns into ASCII ones."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.contains("K") | text.contains("İ"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words in order. Cut at what is no word: the class of that is plain, and on texts with accents many times as fast to match as the negated one of words."""
    return F.array_remove(F.split(lowered(text), GAP, -1), "")


def _vocabulary(templates) -> dict[str, list[str]]:
    return {label: list(dict.fromkeys(re.findall(WORD, text.lower()))) for label, text in templates}


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the vocabulary stands. What reaches the driver is bounded by the vocabulary."""
    held = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r.word: r["count"] for r in held.groupBy("word").count().collect()}


@dataclass(frozen=True)
class Plan:
    """A template ready for the join: its words, rarest first, and how many of them a block needs."""

    label: str
    tokens: tuple[str, ...]
    need: int
    length: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def plan_templates(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, text_col: str = "text") -> list[Plan]:
    by = _vocabulary(templates)
    count = word_frequencies(docs, sorted({w for x in by.values() for w in x}), text_col) if by else {}
    length = {label: len(re.findall(WORD, text.lower())) for label, text in templates}
    return [Plan(label, tuple(sorted(x, key=lambda w: (count.get(w, 0), w))), math.ceil(threshold * len(x) - 1e-9), length[label]) for label, x in by.items() if x]


def _containment(block: Column, plan: Plan) -> Column:
    """Share of the template's words in a block's distinct words, null below the threshold."""
    n, literal = len(plan.tokens), F.array(*map(F.lit, plan.tokens))
    # Of the first token met, the place bounds what can still be met.
    first = F.least(*[F.when(F.array_contains(block, w), F.lit(i)).otherwise(F.lit(n)) for i, w in enumerate(plan.prefix)], F.lit(n))
    may = (F.size(block) >= plan.need) & (n - first >= plan.need)
    share = F.when(may, F.size(F.array_intersect(literal, block)) / F.lit(float(n)))
    return F.when(share * n >= plan.need, share)


def _runs(held: Column, plan: Plan) -> Column:
    """Runs of as many words as the template has that meet the threshold, as an array of (block, label, containment, first, end), empty where there are none.

    Looked at in columns words, sizes and heads (see scan()); held: the words of any template that stand in the text. A run starts with a word of
    the template. Of runs that overlap the best stays, of equally good ones the first; what overlaps it goes, and so on with the rest. A run's block
    is the line that it starts on. Texts that hold too few of the template's words or none of its prefix are not looked at, and each run
    passes the filters of a block.
    """
    literal, none = F.array(*map(F.lit, plan.tokens)), F.array().cast(KIND)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(literal, F.get("words", i)))

    def sized(i: Column) -> Column:
        run = F.slice("words", i + 1, plan.length)
        return F.struct((-_containment(F.array_distinct(run), plan)).alias("worse"), i.alias("first"), (i + F.size(run)).alias("end"))

    fit = F.array_sort(F.filter(F.transform(at, sized), lambda x: x.worse.isNotNull()))
    apart = lambda taken, x: ~F.exists(taken, lambda y: (y.first < x.end) & (x.first < y.end))
    best = F.aggregate(fit, F.array().cast("array<struct<worse:double,first:int,end:int>>"), lambda taken, x: F.when(apart(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    hits = F.transform(best, lambda x: F.struct(_line_of(x.first).alias("block"), F.lit(plan.label).alias("label"), (-x.worse).alias("containment"), x.first.alias("first"), x.end.alias("end")))
    may = (F.size(F.array_intersect(literal, held)) >= plan.need) & F.arrays_overlap(held, F.array(*map(F.lit, plan.prefix)))
    return F.when(may, hits.cast(KIND)).otherwise(none)


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda n, x: n + x)


def _sums(sizes: Column) -> Column:
    """Running sums of an array of numbers."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, x: F.struct((acc.n + x).alias("n"), F.concat(acc.out, F.array(acc.n + x)).alias("out")), lambda acc: acc.out)


def _words_before(line: Column) -> Column:
    """How many words stand before a line. Column sizes has the words of each line, heads their sums up to every CHUNK lines: a text of very many lines is not summed anew for each."""
    chunk = F.floor(line / CHUNK).cast("int")
    return F.coalesce(F.when(chunk > 0, F.get("heads", chunk - 1)), F.lit(0)) + _total(F.slice("sizes", chunk * CHUNK + 1, line % CHUNK))


def _line_of(word: Column) -> Column:
    """The line that a word stands on."""
    chunk = F.size(F.filter("heads", lambda h: h <= word))
    start = F.struct(F.coalesce(F.when(chunk > 0, F.get("heads", chunk - 1)), F.lit(0)).alias("end"), F.lit(0).alias("n"))
    inside = F.aggregate(F.slice("sizes", chunk * CHUNK + 1, F.lit(CHUNK)), start, lambda acc, x: F.struct((acc.end + x).alias("end"), (acc.n + (acc.end + x <= word).cast("int")).alias("n")), lambda acc: acc.n)
    return chunk * CHUNK + inside


def _stands(w: Column, parts: list[str]):
    """Whether parts stand consecutively in w from place i on."""
    return lambda i: reduce(and_, [F.get(w, i + j) == p for j, p in enumerate(parts)])


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, blocks, labels and score.

    base: every place where a phrase's words stand consecutively. blocks: array of (block, label,
    containment, first, end) for every line (numbered from 0) and template that meet the threshold, and for every run of words that
    does (see _runs()), but for runs that overlap a line that is as good; first to end - 1 are its words in the text. score: 1 with
    a base place, else the best containment found, else 0. Null and empty texts: no words, empty
    labels, null first and last word, score 0. Rows are kept as they are, repeats included; columns
    of these names in docs are replaced, all others stay whatever their names.
    """
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks", "labels", "score")
    plans = plan_templates(docs, templates, threshold, text_col)
    # docs' columns travel as one, so that none can bear the name of a column made here.
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    w, n = F.col("words"), F.size("words")
    starts = []
    for phrase in phrases:
        parts = phrase.split()
        starts.append(F.when(F.array_contains(w, parts[-1]) & (n >= len(parts)), F.filter(F.sequence(F.lit(0), n - len(parts)), _stands(w, parts))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("starts", F.array(*starts) if starts else F.array().cast("array<array<int>>"))
    none = F.array().cast(KIND)
    vocabulary, rare = (sorted({t for p in plans for t in getattr(p, of)}) for of in ("tokens", "prefix"))
    if rare:
        held = F.array_intersect(F.array(*map(F.lit, vocabulary)), w)
        df = df.withColumn("held", held).withColumn("may", F.arrays_overlap("held", F.array(*map(F.lit, rare))))
        lines = F.transform(F.split("text", "\n", -1), words)
        df = df.withColumn("lines", F.when(F.col("may"), lines).otherwise(F.array().cast("array<array<string>>")))
        df = df.withColumn("sizes", F.transform("lines", F.size))
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("sizes") - 1, F.lit(0)), F.lit(CHUNK)), lambda at: _total(F.slice("sizes", at + 1, F.lit(CHUNK))))
        df = df.withColumn("heads", _sums(chunks))

        def hits(line: Column, i: Column) -> Column:
            block, first = F.array_distinct(line), _words_before(i)
            found = F.array(*[F.struct(F.lit(p.label).alias("label"), _containment(block, p).alias("containment")) for p in plans])
            met = F.transform(F.filter(found, lambda x: x.containment.isNotNull()), lambda x: F.struct(i.alias("block"), x.label.alias("label"), x.containment.alias("containment"), first.alias("first"), (first + F.size(line)).alias("end")))
            return F.when(F.arrays_overlap(block, F.array(*map(F.lit, rare))), met.cast(KIND)).otherwise(none)

        df = df.withColumn("by_line", F.when(F.col("may"), F.flatten(F.transform("lines", hits)).cast(KIND)).otherwise(none))
        df = df.withColumn("by_run", F.when(F.col("may"), F.concat(*[_runs(F.col("held"), p) for p in plans])).otherwise(none))
        better = F.filter("by_run", lambda x: ~F.exists("by_line", lambda y: (y.label == x.label) & (y.containment >= x.containment) & (y.first < x.end) & (x.first < y.end)))
        df = df.withColumn("blocks", F.concat("by_line", better))
    else:
        df = df.withColumn("blocks", none)
    every = F.flatten("starts")
    base = F.array_compact(F.array(*[F.when(F.size(F.get("starts", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values())])) if phrases else F.array().cast("array<string>")
    found = F.transform("blocks", lambda x: x.label)
    return df.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made],
        n.cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        "blocks",
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda x: x.containment)), F.lit(0.0))).alias("score"),
    )
