"""Equality of query results up to the order of columns and, where it does not matter, of rows."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(value):
    """A hashable form of a JSON value: lists sorted, objects as sorted pairs, numbers and booleans by value."""
    if isinstance(value, list):
        return ("list", tuple(sorted((cell(v) for v in value), key=repr)))
    if isinstance(value, dict):
        return ("map", tuple(sorted((k, cell(v)) for k, v in value.items())))
    return value


def equal(a: list[list], b: list[list], ordered: bool) -> bool:
    """Whether some order of b's columns makes it a: as lists if ordered, else as multisets of rows.

    Columns are matched by the multiset of their cells, over all rows, before whole rows are tried.
    """
    if not a and not b:
        return True
    if len(a) != len(b) or len({len(r) for r in a + b}) != 1:
        return False
    x, y = ([tuple(cell(v) for v in r) for r in t] for t in (a, b))
    width = len(x[0])
    column = lambda t, i: tuple(r[i] for r in t) if ordered else frozenset(Counter(r[i] for r in t).items())
    mine, theirs = [column(x, i) for i in range(width)], [column(y, i) for i in range(width)]
    may = [[j for j in range(width) if theirs[j] == c] for c in mine]
    if not all(may):
        return False
    if ordered:
        return Counter(mine) == Counter(theirs)
    want = Counter(x)

    def search(i: int, used: tuple[int, ...]) -> bool:
        if i == width:
            return Counter(tuple(r[j] for j in used) for r in y) == want
        tried = set()
        for j in may[i]:
            # Columns alike in every row are interchangeable.
            key = tuple(r[j] for r in y)
            if j in used or key in tried:
                continue
            tried.add(key)
            part = (*used, j)
            if Counter(tuple(r[k] for k in part) for r in y) == Counter(r[: i + 1] for r in x) and search(i + 1, part):
                return True
        return False

    return search(0, ())


def is_ordered(gold_query: str) -> bool:
    return "order by" in gold_query.lower()


@F.pandas_udf(T.DoubleType())
def execution_accuracy(predicted: pd.Series, gold: pd.Series, gold_query: pd.Series) -> pd.Series:
    """1 or 0 by row; results as JSON arrays of arrays. A null prediction failed and scores 0; a null gold gives null."""
    rows = []
    for p, g, q in zip(predicted, gold, gold_query):
        rows.append(None if g is None else 0.0 if p is None else float(equal(json.loads(g), json.loads(p), is_ordered(q or ""))))
    return pd.Series(rows, dtype="float64")


