"""Vectorised 64-bit hashes of words and of runs of words, the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


#: Powers of a base that have been worked out, up to a fixed number.
_KNOWN: dict[int, np.ndarray] = {}
_KEPT = (1 << 20) + 1


def _powers(base: int, n: int) -> np.ndarray:
    known = _KNOWN.get(base, _BYTE[:0])
    if len(known) < n:
        known = np.full(max(n, min(_KEPT, 2 * n)), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= _KEPT:
            _KNOWN[base] = known
    return known[:n]


_INVERSE = pow(int(_ODD), -1, 2**64)

#: Bytes of text that a function takes at once, which bounds its arrays; any number gives the same result.
PORTION = 2 << 20


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in a column have at most so many bytes; a longer text stands alone."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def words_of(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: (hash of each word in order, number of words of each text).

    lower: A-Z count as a-z. A null text has no word.
    """
    raw = pa.compute.fill_null(texts.cast(pa.large_string()).cast(pa.large_binary()), b"")
    _, offsets, body = raw.buffers()
    first = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[first[0] : first[-1]] if body is not None and first[-1] > first[0] else np.empty(0, np.uint8)
    first = first - first[0]
    word = ~_SPACE[data]
    before = np.concatenate([[False], word])
    before[first] = False
    after = np.append(word, False)
    start = np.flatnonzero(word & ~before[:-1])
    after[first] = False
    end = np.flatnonzero(word & ~after[1:]) + 1
    count = np.bincount(np.searchsorted(first, start, side="right") - 1, minlength=len(raw)).astype(np.int64)[: len(raw)]
    out = np.empty(len(start), np.uint64)
    # In slices of words: the sums of a slice need eight bytes for each byte of text.
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + 1_000_000)))
        lo, hi = int(start[at]), int(end[stop - 1])
        piece = data[lo:hi]
        powers = _powers(int(_ODD), hi - lo)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[piece] if lower else piece] * powers, dtype=np.uint64)])
        a, b = start[at:stop] - lo, end[at:stop] - lo
        back = _powers(_INVERSE, hi - lo)
        out[at:stop] = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * _ODD)
        at = stop
    return out, count


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; entry i covers words i..i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + words[j : j + n]) * _ODD
        out ^= out >> np.uint64(29)
    return mix(out)


def span_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of words[start:end] for many spans at once, by sums of powers."""
    if not len(words):
        return np.zeros(len(start), np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + _ODD) * _powers(int(_ODD), len(words)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(words) + 1)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
