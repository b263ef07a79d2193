"""Lexical retrieval packing: sequences of a fixed number of tokens, filled with related documents.

Documents are encoded where they lie and dealt by content: sorted over the whole corpus by the two ids that
mark them most. So those that share rare ids come together from wherever they lay, and copies side by side.
Consecutive documents make a shard of bounded size, with a BM25 inverted index over the parts that do not fill
a sequence by themselves. A seed opens a window and asks with all its ids; its unused neighbours fill the
window in order of their score; the neighbour that no longer fits is cut, and its rest stays in the index.
What a shard leaves over moves on to the next, so only the last sequence of a partition is short of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .wordhash import portions

_LOADED: dict[tuple, object] = {}


class Encoder:
    """Ids of a text as the tokenizer file gives them.

    ranks_path: the same vocabulary as ranks, for a faster encoder with the same ids; texts that hold
    one of the file's special strings always go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str, ranks_path: str | None = None) -> Encoder:
    """The encoder of a file, once for each worker."""
    if (path, ranks_path) not in _LOADED:
        _LOADED[path, ranks_path] = Encoder(path, ranks_path)
    return _LOADED[path, ranks_path]


class Index:
    """BM25 over units, each a run of ids, with the units' inverted lists."""

    def __init__(self, units: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        size = np.array([len(u) for u in units], np.int64)
        flat = np.concatenate(units).astype(np.int64)
        key, tf = np.unique(flat * len(units) + np.repeat(np.arange(len(units)), size), return_counts=True)
        term, self.unit = key // len(units), key % len(units)
        self.terms, first = np.unique(term, return_index=True)
        self.end = np.append(first[1:], len(term))
        self.first = first
        df = self.end - first
        self.idf = np.log(1 + (len(units) - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * size / size.mean())
        self.weight = np.repeat(self.idf, df) * tf * (k1 + 1) / (tf + norm[self.unit])
        self.n = len(units)

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """Units by falling score for all distinct ids; ties by place."""
        at = np.searchsorted(self.terms, np.unique(ids))
        first, df = self.first[at], self.end[at] - self.first[at]
        place = np.arange(df.sum()) + np.repeat(first - (np.cumsum(df) - df), df)
        return np.argsort(-np.bincount(self.unit[place], weights=self.weight[place], minlength=self.n), kind="stable")


def fill(units: list[np.ndarray], length: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Windows of exactly ``length`` ids from units, each shorter than that, and what is left over.

    A window is a list of (unit, from, to); the rest a list of (unit, from) with less than length ids in all.
    """
    if not units:
        return [], []
    index = Index(units)
    start = np.zeros(len(units), np.int64)
    left = np.array([len(u) for u in units], np.int64)
    total, windows, seed = int(left.sum()), [], 0
    while total >= length:
        while not left[seed]:
            seed += 1
        window, free = [(seed, int(start[seed]), int(start[seed] + left[seed]))], length - int(left[seed])
        query = units[seed][start[seed] :]
        left[seed] = 0
        if free:
            order = index.neighbours(query)
            order = order[left[order] > 0]
            # Whole neighbours in order while they fit, the next one cut to what is free.
            for u in order:
                take = min(free, int(left[u]))
                window.append((int(u), int(start[u]), int(start[u]) + take))
                start[u] += take
                left[u] -= take
                free -= take
                if not free:
                    break
        windows.append(window)
        total -= length
    return windows, [(int(u), int(start[u])) for u in np.flatnonzero(left)]


def marks(ids: np.ndarray) -> tuple[int, int]:
    """The two ids that mark a document: those that stand in it often for how late they come in the vocabulary.

    Vocabularies are in order of falling frequency, and the logarithm of a place in such an order is about that
    of how rarely the id stands. One id gives the second as -1, none both.
    """
    found, n = np.unique(ids, return_counts=True)
    best = np.lexsort((found, -np.log1p(n) * np.log(found + 2.0)))[:2]
    return (*(int(found[i]) for i in best), *[-1] * (2 - len(best)))


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoded(docs: DataFrame, names: list[str], tokenizer_path: str, ranks_path: str | None, end_id: int, text_col: str) -> DataFrame:
    """docs' named columns as struct row, with first and second mark, crc of the ids, and the ids in bytes (2 for each where that is enough)."""
    base = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            for b in portions(batch, 1):
                ids = [np.array([*run(t.as_py()), end_id], np.uint32) for t in b.column(1)]
                first, second = zip(*(marks(x[:-1]) for x in ids))
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                n = [len(x) for x in ids]
                raw = [(x.astype("<u2") if x.max() < 65536 else x.astype("<u4")).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["row", "first", "second", "crc", "n", "ids"])

    return scratch.keep(base.mapInArrow(encode, f"row {dict(base.dtypes)['row']}, first long, second long, crc long, n long, ids binary"), "encoded")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, length: int = 1024, end_id: int = 0, shard: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: bool = False) -> DataFrame:
    """One row per piece: the document's id, PIECES, and with with_ids the piece's ids (array<int>).

    A document is its text's ids and end_id; each of its ids lies in exactly one piece. A sequence
    holds up to length ids, without gaps from offset 0; all but the last of a partition hold length.
    shard: documents that share an index. keep: all columns of docs with each piece; those named like
    PIECES are replaced. Null and empty texts are end_id alone. Rows stay apart, repeats included; an
    empty table gives no pieces.
    """
    columns = [x.split()[0] for x in PIECES.split(", ")]
    names = [c for c in (docs.columns if keep else [id_col]) if c not in {*columns, "ids"}]
    encoded = _encoded(docs, names, tokenizer_path, ranks_path, end_id, text_col)
    kind = f"row {dict(encoded.dtypes)['row']}, {PIECES}" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        rest: list[tuple] = []  # (row, place of its first id, its ids, ids of its document) waiting for a window

        def give(pieces: list[tuple]) -> pa.RecordBatch:
            """pieces: (row, start, ids, doc_tokens, sequence, offset)."""
            made = [
                [p[1] for p in pieces], [len(p[2]) for p in pieces], [zlib.crc32(p[2].astype("<u4").tobytes()) for p in pieces],
                [p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces],
            ]
            extra = [pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32()))] if with_ids else []
            return pa.RecordBatch.from_arrays([pa.concat_arrays([p[0] for p in pieces]), *(pa.array(m, pa.int64()) for m in made), *extra], names=["row", *columns, *["ids"] * with_ids])

        def close(last: bool):
            nonlocal sequence, rest
            windows, left = fill([u[2] for u in rest], length)
            if last and left:
                windows.append([(u, at, len(rest[u][2])) for u, at in left])
                left = []
            pieces = []
            for window in windows:
                offset = 0
                for u, lo, hi in window:
                    row, place, ids, n = rest[u]
                    pieces.append((row, place + lo, ids[lo:hi], n, sequence, offset))
                    offset += hi - lo
                sequence += 1
            rest = [(rest[u][0], rest[u][1] + at, rest[u][2][at:], rest[u][3]) for u, at in left]
            if pieces:
                yield give(pieces)

        for b in batches:
            whole = []
            for i, n in enumerate(b.column("n").to_pylist()):
                raw = b.column("ids")[i].as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype(np.uint32)
                row = b.column("row").slice(i, 1)
                cut = n // length * length
                for at in range(0, cut, length):
                    whole.append((row, at, ids[at : at + length], n, sequence, 0))
                    sequence += 1
                if cut < n:
                    rest.append((row, cut, ids[cut:], n))
                if len(whole) >= 1000:
                    yield give(whole)
                    whole = []
                if len(rest) >= shard:
                    yield from close(False)
            if whole:
                yield give(whole)
        yield from close(True)

    # Rows of one content are told apart, so that a range may end among them.
    order = ["first", "second", "crc", F.xxhash64("row")]
    dealt = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n", "ids")
    return dealt.mapInArrow(run, kind).select("row.*", *columns, *["ids"] * with_ids)
