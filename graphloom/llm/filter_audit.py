"""Filter interaction audit: what each of five filters removes, in every order, from a histogram of failure masks.

Native expressions give every document a mask, one bit for each filter that it fails; for the filter on repeated
texts, a groupBy of texts (by SHA-256, so that no text is shuffled) supplies the smallest id of each. Counts by part and mask,
32 cells at most for each part, are summed before the shuffle and hold all that the 120 orders need: they
are enumerated from the cells, never from documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

LETTERS = "ABCDE"

#: Separators of words: space and \x09-\x0D.
BLANK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANK, -1), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask) for every row of docs; bit i of the mask is set where filter LETTERS[i] fails.

    part: the column's value as text, null as the empty string. E fails where any smaller id of the table has the same text: of rows that share an
    id and a text none is smaller, and a row without id neither fails E nor makes another fail. Repeated rows each count.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shaped = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    alone = failures(F.col("text"))
    bits = sum(((1 << LETTERS.index(k)) * c.cast("int") for k, c in alone.items()), F.lit(0))
    facts = scratch.keep(shaped.select("id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "facts")
    # Only texts of several rows have anything to look up.
    least = facts.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    joined = facts.join(scratch.keep(least, "least"), "digest", "left")
    repeated = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    return joined.select("id", "part", (F.col("bits") + (1 << LETTERS.index("E")) * repeated).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, label_id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents in each cell, and those that a label row calls good (quality 1) or toxic.

    Several label rows of one id count as one that says what any of them says; documents without label are neither.
    """
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.where(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    joined = masked.join(scratch.keep(marks.where("good + toxic > 0"), "marks"), "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows for each part, zeros included.

    See masks() and cells() for nulls, repeats and ties. An empty table has no parts and gives no rows. Other columns
    of docs and labels are not looked at.
    """
    by_part = scratch.keep(cells(masks(docs, part_col, id_col, text_col), labels), "cells")
    by_part = by_part.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    bit = {x: 1 << i for i, x in enumerate(LETTERS)}
    steps = [
        F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(o[i]).alias("letter"), F.lit(bit[o[i]]).alias("bit"), F.lit(sum(bit[x] for x in o[:i])).alias("earlier"))
        for o in permutations(LETTERS)
        for i in range(len(o))
    ]
    every = by_part.select("part", "cells", F.explode(F.array(*steps)).alias("s")).select("part", "cells", "s.*")

    def count(what: str, where) -> Column:
        """Documents of the part's cells for which where(mask) holds."""
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, x: acc + F.when(where(x.mask), x[what]).otherwise(F.lit(0).cast("long")))

    own, earlier = F.col("bit"), F.col("earlier")
    fails, stands = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(earlier) == 0
    lost = lambda m: fails(m) & stands(m)
    counted = every.select(
        "part",
        "filter_order",
        "step",
        "letter",
        count("n", lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"),
        count("n", lost).alias("removed"),
        count("n", lambda m: fails(m) & ~stands(m)).alias("redundant"),
        count("n", lambda m: m == own).alias("unique_fails"),
        count("good", lost).alias("good_lost"),
        count("toxic", lost).alias("toxic_lost"),
    )
    # 120 rows for each filter of a part.
    return counted.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")
