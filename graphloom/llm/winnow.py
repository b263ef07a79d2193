"""Benchmark decontamination by winnowing: every benchmark window that stands in a document, word for word.

A window is ``length`` consecutive words of an item; an item of fewer words is one window. Each window keeps
the smallest hash among its runs of SEED words (the last of equals) as its fingerprint, and so does every
window of a document: equal windows keep the same run at the same place, which guarantees that every shared
span of ``length`` words meets. Documents are scanned once, where they lie; a window goes on only if
its fingerprint is marked in a bitmap of the benchmark's fingerprints, whose size is fixed whatever the
benchmark's (with a very large benchmark it lets more through, never less). Fingerprints are then joined, and a hit is
extended both ways over the words of the window: the join also compares them as text, not by a hash.

The benchmark's side of that join holds each window once, so a window that stands in very many documents or
items makes one row for each place, no pairs. Windows that stand in the same items share a
class, and documents that meet the same classes share one list of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, wordhash
from .substring import least_last

SEED = 5

#: Bits of the fingerprint bitmap: 8 MB, in rows of 4 KB.
BITS = 1 << 26

#: Bytes of words as themselves, A-Z as a-z, all others as a space: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lowered.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[65:91] = _PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)

_WINDOW = "array<struct<fp:long,length:int,span:string,at:array<int>>>"


def plain(texts: pa.Array) -> pa.Array:
    """Texts whose words are lowered and parted by spaces; null is empty."""
    raw = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, body = raw.buffers()
    if body is None or not len(raw):
        return raw
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = _PLAIN[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])


def windows_of(words: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in its text, fingerprint) of every window of a length, for texts laid end to end."""
    k = min(SEED, length)
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = wordhash.runs_of(words, k)
    kept = grams[least_last(grams, length - k + 1)]
    end = np.cumsum(count)
    owner = np.repeat(np.arange(len(count)), count)[: len(kept)]
    inside = np.flatnonzero(np.arange(len(kept)) + length <= end[owner])
    owner = owner[inside]
    return owner, inside - (end - count)[owner], kept[inside]


def _spans(text: bytes, starts: np.ndarray, prints: np.ndarray, length: int) -> list[dict]:
    """The windows of one text at some starts, equal ones together."""
    words, found = text.split(), {}
    for s, fp in zip(starts.tolist(), prints.view(np.int64).tolist()):
        found.setdefault(b" ".join(words[s : s + length]).decode(), (fp, []))[1].append(s)
    return [{"fp": fp, "length": length, "span": span, "at": at} for span, (fp, at) in found.items()]


def item_windows(items: DataFrame, length: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, fp, length, span) of all windows of all items; rows without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in wordhash.portions(batch, 1)):
            texts = plain(b.column(1))
            words, count = wordhash.words_of(texts, lower=False)
            found = [[] for _ in range(len(count))]
            for n in np.unique(np.minimum(count[count > 0], length)).tolist():
                owner, start, fp = windows_of(words, count, n)
                mine = np.minimum(count[owner], length) == n
                owner, start, fp = owner[mine], start[mine], fp[mine]
                for lo, hi in _runs(owner):
                    found[owner[lo]] += _spans(texts[int(owner[lo])].as_py().encode(), start[lo:hi], fp[lo:hi], n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _HITS)], names=["item", "windows"])

    shaped = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return shaped.mapInArrow(cut, f"item string, windows {_WINDOW}").select("item", F.explode("windows").alias("w")).select("item", "w.fp", "w.length", "w.span")


_HITS = pa.list_(pa.struct([("fp", pa.int64()), ("length", pa.int32()), ("span", pa.string()), ("at", pa.list_(pa.int32()))]))


def _runs(owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal neighbours."""
    cut = np.flatnonzero(np.diff(owner)) + 1
    return zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(owner)]]).tolist()) if len(owner) else iter(())


def bitmap(windows: DataFrame) -> np.ndarray:
    """Marks of the windows' fingerprints as BITS bits; the driver gets at most as many, whatever the table's size."""
    bit = F.pmod(F.col("fp"), F.lit(BITS)) + 1
    rows = windows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, items) for every row of docs.

    spans: array of (lo, hi), the maximal stretches of words that lie in occurring windows, in order.
    items: the ids of the items that have such a window, as strings in code-point order, once each. Rows stay one for
    one, repeats included; other columns of docs and items, whatever their names, are not looked at. Null and empty texts have no
    words and are not hit; items without words have no window; an item without id marks words but is not
    listed. No items or no documents: no spans, no rows.
    """
    spark = docs.sparkSession
    windows = scratch.keep(item_windows(items, length, item_id_col, item_text_col), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    marks = spark.sparkContext.broadcast(bitmap(windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for b in (p for batch in batches for p in wordhash.portions(batch, 1)):
            texts = plain(b.column(1))
            words, count = wordhash.words_of(texts, lower=False)
            found = [None] * len(count)
            for n in lengths:
                owner, start, fp = windows_of(words, count, n)
                at = fp & np.uint64(BITS - 1)
                met = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                owner, start, fp = owner[met], start[met], fp[met]
                for lo, hi in _runs(owner):
                    i = int(owner[lo])
                    found[i] = (found[i] or []) + _spans(texts[i].as_py().encode(), start[lo:hi], fp[lo:hi], n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(found, _HITS)], names=["id", "n_words", "hits"])

    shaped = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = shaped.mapInArrow(scan, f"id {dict(shaped.dtypes)['id']}, n_words long, hits {_WINDOW}")
    # A row is known by its place from here on: the number is fixed once the table is written.
    scanned = scratch.keep(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    by_window = windows.groupBy("fp", "span").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_window = scratch.keep(by_window.withColumn("class", F.md5(F.to_json("items"))), "by-window")
    hits = scanned.where("hits is not null").select("row", F.explode("hits").alias("h")).select("row", "h.*")
    extended = hits.join(by_window.select("fp", "span", "class"), ["fp", "span"]).select("row", "length", "at", "class")
    met = extended.groupBy("row").agg(F.collect_list(F.struct("length", "at")).alias("windows"), F.array_sort(F.collect_set("class")).alias("classes"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_union(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), b.column(2)], names=["row", "spans", "classes"])

    met = met.mapInArrow(merge, "row long, spans array<struct<lo:int,hi:int>>, classes array<string>")
    met = scratch.keep(met.withColumn("combination", F.sha2(F.concat_ws(",", "classes"), 256)), "met")
    listed = by_window.groupBy("class").agg(F.first("items").alias("items"))
    lists = met.select("combination", "classes").dropDuplicates(["combination"]).select("combination", F.explode("classes").alias("class"))
    lists = lists.join(scratch.keep(listed, "classes"), "class").select("combination", F.explode_outer("items").alias("item"))
    lists = scratch.keep(lists.groupBy("combination").agg(F.array_sort(F.collect_set("item")).alias("items")), "lists")
    found = met.select("row", "spans", "combination").join(lists, "combination")
    out = scanned.select("row", "id", "n_words").join(found, "row", "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _union(windows: list[dict]) -> list[tuple[int, int]]:
    """Maximal stretches of words under windows given as (length, starts)."""
    size = [len(w["at"]) for w in windows]
    lo = np.concatenate([np.asarray(w["at"], np.int64) for w in windows])
    hi = lo + np.repeat([w["length"] for w in windows], size)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:], len(lo)) - 1
    return list(zip(lo[fresh].tolist(), hi[last].tolist()))
