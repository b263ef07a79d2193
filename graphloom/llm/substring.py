"""Substring dedup by seed and extend: repeats of a given number of words, wherever they start.

Seeds are winnowed: every window of ``length`` words picks the smallest hash among its runs of SEED
words (the last of equals), so equal windows pick the same seed at the same place. The windows of one
document that share a seed form a run. Documents are joined on seeds; where a seed's whole run stands
elsewhere too, it is repeated as it is; other runs of a repeated seed are extended both ways against
the texts, window by window. Overlapping repeated windows add up to maximal repeats.

No pair of occurrences is ever made: occurrences are counted by hash before the shuffle and joined to
what was found repeated, so the work is linear in the text whatever the size of a group of copies.
Windows are compared by two 64-bit hashes, that of their seed and that of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, wordhash

SEED = 8


def least_last(key: np.ndarray, width: int) -> np.ndarray:
    """For every run of width values the place of the smallest, the last of equals."""
    at, reach = np.arange(len(key)), 1
    later = lambda a, b: np.where(key[b] <= key[a], b, a)
    while reach * 2 <= width:
        at = later(at[:-reach], at[reach:])
        reach *= 2
    if width > reach:
        at = later(at[: len(at) - (width - reach)], at[width - reach :])
    return at


def seeds_of(words: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by the seed they pick, for texts laid end to end.

    (text, first window counted in its text, number of windows, hash of the seed, hash of the run).
    """
    k = min(SEED, length)
    if len(words) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = wordhash.runs_of(words, k)
    pick = least_last(grams, length - k + 1)
    end = np.cumsum(count)
    first = end - count
    owner = np.repeat(np.arange(len(count)), count)[: len(pick)]
    inside = np.flatnonzero(np.arange(len(pick)) + length <= end[owner])
    pick, owner = pick[inside], owner[inside]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(pick) != 0) | (np.diff(owner) != 0)])[: len(pick)])
    n = np.diff(np.append(fresh, len(pick)))
    lo = inside[fresh]
    run = wordhash.span_hash(words, lo, lo + n - 1 + length)
    return owner[fresh], lo - first[owner[fresh]], n, grams[pick[fresh]], run


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def repeated_spans(docs: DataFrame, length: int = 35) -> DataFrame:
    """(row, spans array<struct<lo, hi>>): words lo to hi-1 stand in windows that start elsewhere, too.

    docs: row (what tells rows apart, of any type; rows alike in it must be alike in text), text. Rows
    without a repeat are left out. Null, empty and short texts have no window.
    """
    row = f"row {dict(docs.dtypes)['row']}"

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.portions(batch, 1):
                words, count = wordhash.words_of(b.column(1), lower=False)
                owner, lo, n, seed, run = seeds_of(words, count, length)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), _int(lo), _int(n), _long(seed), _long(run)], names=["row", "lo", "n", "seed", "run"])

    runs = scratch.keep(docs.select("row", "text").mapInArrow(seeds, f"{row}, lo int, n int, seed long, run long"), "runs")
    shared = scratch.keep(runs.groupBy("seed").count().where("count > 1").select("seed"), "seeds")
    met = scratch.keep(runs.join(shared, "seed"), "met")
    scratch.drop(runs)
    scratch.drop(shared)
    by = scratch.keep(met.groupBy("seed", "run").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "n")).alias("o")), "by")
    whole, alone = by.where("c > 1"), by.where("c = 1")
    # A run that stands alone may share windows with others of its seed: with others that stand
    # alone, and with those that stand in several places, of which one will do.
    edges = alone.select("o.*", "seed", F.lit(True).alias("edge"))
    others = whole.join(alone.select("seed").distinct(), "seed", "left_semi").select("o.*", "seed", F.lit(False).alias("edge"))
    wanted = edges.union(others).groupBy("row").agg(F.collect_set(F.struct("lo", "n", "seed", "edge")).alias("runs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in wordhash.portions(batch, 1):
                words, count = wordhash.words_of(b.column(1), lower=False)
                first = np.cumsum(count) - count
                lists = b.column(2)
                flat, size = lists.flatten(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                lo, n, seed = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "n", "seed"))
                edge = flat.field("edge").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(count)), size)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(lo, n) + step
                at = start + np.repeat(first[owner], n)
                h = wordhash.span_hash(words, at, at + length)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(owner, n))), _int(start), _long(np.repeat(seed, n)), _long(h), pa.array(np.repeat(edge, n).astype(bool))], names=["row", "lo", "seed", "h", "edge"])

    texts = docs.select("row", "text").join(wanted, "row")
    windows = scratch.keep(texts.mapInArrow(extend, f"{row}, lo int, seed long, h long, edge boolean"), "windows")
    twice = scratch.keep(windows.groupBy("seed", "h").count().where("count > 1").select("seed", "h"), "twice")
    parts = windows.where("edge").join(twice, ["seed", "h"]).select("row", "lo", (F.col("lo") + length).alias("hi"))
    full = met.join(whole.select("seed", "run"), ["seed", "run"]).select("row", "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi"))
    return full.union(parts).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def drop_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, keep: bool = False) -> DataFrame:
    """docs' id with n_words, n_removed and kept: the words outside repeated windows, joined by one space.

    Every occurrence of a repeated window goes, the first included. digest: kept_sha256 (lower-case
    hex of kept in UTF-8) in place of kept. keep: all columns of docs, the text replaced by kept where
    a word went and left as it is elsewhere, with n_words and n_removed. Rows stay one for one, repeats
    included (which then repeat each other). Null and empty texts: no words, kept empty (with keep:
    unchanged). Columns named n_words or n_removed are replaced.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")] if keep else [id_col]
    text = F.col(text_col).cast("string")
    row = F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(text, id_col).alias("b"))
    keyed = docs.select(F.struct(*others).alias("others"), text.alias("text"), row.alias("row"))
    spans = repeated_spans(keyed, length)
    last = "kept" if keep or not digest else "kept_sha256"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in wordhash.portions(batch, 1)):
            n_words, n_removed, kept = [], [], []
            lists = b.column(2)
            for i, text in enumerate(b.column(1).cast(pa.binary())):
                raw = text.as_py()
                words = (raw or b"").split()
                n = len(words)
                if lists[i].is_valid:
                    cover = np.zeros(n + 1, np.int64)
                    spans = lists[i].values
                    np.add.at(cover, spans.field("lo").to_numpy(), 1)
                    np.add.at(cover, spans.field("hi").to_numpy(), -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
                n_words.append(n)
                n_removed.append(n - len(words))
                body = raw if keep and n == len(words) else b" ".join(words)
                kept.append(body if body is None or last == "kept" else hashlib.sha256(body).hexdigest())
            final = pa.array(kept, pa.binary()).cast(pa.string()) if last == "kept" else pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), final], names=["others", "n_words", "n_removed", last])

    joined = keyed.join(spans, "row", "left").select("others", "text", "spans")
    made = joined.mapInArrow(cut, f"others {dict(keyed.dtypes)['others']}, n_words long, n_removed long, {last} string")
    if not keep:
        return made.select("others.*", "n_words", "n_removed", last)
    order = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return made.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"others.`{c}`").alias(c) for c in order], "n_words", "n_removed")
