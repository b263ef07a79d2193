"""Spelling variant grouping: words one edit apart, found by a rare-first prefix filter on positional bigrams.

Bigrams are ordered over the whole vocabulary, rarest first. One edit spoils at most two bigrams of a word, so two words
one edit apart share one of the three rarest of each, at the same place or, past an inserted
letter, one further on; equal bigrams of one word are ordered by place, which keeps that true for them. Words are joined
on these three only, by bigram, place and length of the shorter word. One edit also leaves the shorter word's
first or second half as it is, so each key holds a half, too: that splits the groups of frequent bigrams and
loses no pair. What meets is verified by edit distance.

Words are counted before the shuffle; everything after that grows with the vocabulary, not with the text. Only
the order of bigrams is broadcast: there are at most 90 * 90, by the alphabet. All other joins are told to merge: a kept table
is small on disk, and once exploded it is many times what Spark takes it for, too much for a driver to send around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Letters of a run. With A-Z lowered they are 26 + 64 = 90.
LETTER = r"[A-Za-zÀ-ÿ]"

#: Grams per word in the join: an edit spoils two.
RAREST = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    """A-Z as a-z and nothing else; translate() only where lower() says that there is something to lower."""
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, _UPPER, _LOWER))


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, slip: int | None = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least so many code points and occurrences in docs.

    Words are maximal runs of LETTER with A-Z lowered. slip: a run loses the code point at place h % length
    where slip divides h, the CRC-32 of ``<id>:<run>``; None leaves runs as they are. A null id counts as the empty string.
    """
    # Shorter runs make no word, and one that loses a letter only gets shorter.
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("word"))
    if slip is not None:
        word, h = F.col("word"), F.col("h")
        at = (h % F.length(word)).cast("int")
        words = words.select("word", F.crc32(F.concat_ws(":", "id", "word")).alias("h"))
        words = words.select(F.when(h % slip == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, length, grams): the three rarest bigrams of each word as an array of (gram, at)."""
    each = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("at", "gram"))
    frequency = each.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = each.join(F.broadcast(frequency), "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "at"))).alias("all"))
    return ranked.select("word", F.length("word").alias("length"), F.transform(F.slice("all", 1, RAREST), lambda x: F.struct(x.gram.alias("gram"), x.at.alias("at"))).alias("grams"))


def _keyed(grams: DataFrame, longer: bool) -> DataFrame:
    """Rows (length, gram, at, side, half, word) under which a word meets others.

    length, at and half are those of the shorter word of a pair. longer: the word as the one with a letter more.
    """
    short = F.col("length") - (1 if longer else 0)
    cut = (short / 2).cast("int")
    place = F.col("g.at") - F.col("back")
    backs = F.array(F.lit(0), F.lit(1)) if longer else F.array(F.lit(0))
    rows = grams.select("word", "length", F.explode("grams").alias("g")).select("*", F.explode(backs).alias("back")).where(place >= 0)
    halves = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), cut).alias("half")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - (short - cut) + 1, short - cut).alias("half")))
    return rows.select("word", short.alias("length"), F.col("g.gram").alias("gram"), place.alias("at"), F.explode(halves).alias("h")).select("length", "gram", "at", "h.side", "h.half", "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), both ways, for all words of a distinct vocabulary that one inserted, deleted or replaced code point parts."""
    grams = scratch.keep(rarest_bigrams(words), "grams")
    key = ["length", "gram", "at", "side", "half"]
    short, long = _keyed(grams, False), _keyed(grams, True)
    replaced = short.join(short.withColumnRenamed("word", "near").hint("merge"), key).where("word < near")
    inserted = short.join(long.withColumnRenamed("word", "near").hint("merge"), key)
    met = replaced.select("word", "near").union(inserted.select("word", "near"))
    one = scratch.keep(met.where(F.levenshtein("word", "near", 1) == 1).distinct(), "near")
    return one.union(one.select(F.col("near").alias("word"), F.col("word").alias("near")))


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of a vocabulary (word, n) of distinct words.

    form: the near word of largest n (ties: smallest in code-point order) where that n is at least factor times the word's; else null. root: the
    last word that forms lead to. An empty vocabulary gives no rows. factor must be 2 or more: forms must not lead in circles.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = near_pairs(words).join(counts.hint("merge"), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("b"))
    joined = words.join(best.hint("merge"), "word", "left").withColumn("of", F.when(-F.col("b.m") >= factor * F.col("n"), F.col("b")))
    formed = scratch.keep(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("of.near").alias("form"), (-F.col("of.m")).alias("form_n")), "formed")
    # Each form is factor times as frequent, so a chain of counts has under 64 / log2(factor) links and doubling its reach settles soon.
    steps, reach = formed.where("form is not null").select("word", F.col("form").alias("root")), 1
    while reach < 64:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = scratch.keep(steps.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps, reach = further.select("word", "root"), 2 * reach
        if not further.where("moved").limit(1).count():
            break
    return formed.join(steps.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, slip: int | None = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group_variants() of the vocabulary() of docs. Null and empty texts have no words; repeated rows count each; other columns are not looked at."""
    return group_variants(scratch.keep(vocabulary(docs, shortest, least, slip, id_col, text_col), "vocabulary"), factor)
