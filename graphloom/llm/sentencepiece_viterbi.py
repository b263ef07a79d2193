"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation has the highest sum of piece scores. Positions are visited once; only a window
as long as the longest piece is kept, because no later piece can start before it. Whenever the back
pointers of all positions in the window lead through one boundary, the ids before it are final and are
given out. Boundaries that no piece can cross (known from the vocabulary alone) are such points too;
text between two of them is encoded once per worker and remembered.

Scores are those in the model file, whatever its type; equal sums go to the longer last piece. A
character that no piece covers is written as byte pieces at a fixed penalty below every score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import merge
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import portions

SPACE = "▁"
_LOADED: dict[str, "Vocabulary"] = {}


class Remembered(dict):
    """What a function gave for short strings: all of the last ROOM found, and those before them once more."""

    ROOM, LONGEST = 200_000, 64

    def __init__(self, function):
        self.function, self.before = function, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        found = self.before.get(key)
        if found is None:
            found = self.function(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.ROOM:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {self.pieces[i]: (i, float(sp.get_score(i))) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.penalty = min((s for _, s in self.ids.values()), default=0.0) - 10.0
        # Finds all pieces that end at a position, the longest first.
        self.matcher = ahocorasick.Automaton()
        for p, (i, score) in self.ids.items():
            self.matcher.add_word(p, (i, len(p), score))
        self.matcher.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, self.ids), default=1)
        # Ids that are text by themselves; the others (parts of a longer character, control ids) are None.
        self.text: list[str | None] = [None] * n
        for i in plain:
            self.text[i] = self.pieces[i]
        for b, i in self.bytes.items():
            if b < 128:
                self.text[i] = chr(b)
        self.prefix = sp.encode("a") and sp.decode(sp.encode("a")) == "a" and self.pieces[sp.encode("a")[0]].startswith(SPACE)
        # Where no piece can cross: before a space mark, unless a piece holds one after something else;
        # and around characters that stand in no longer piece.
        several = [p for p in self.ids if len(p) > 1]
        joined = set("".join(several))
        inner = any(SPACE in p.lstrip(SPACE) for p in several)
        self.alone = {c for c in ("\n\t\r" + "".join(self.single)) if c not in joined}
        alone = "".join(map(re.escape, sorted(self.alone)))
        other = rf"[^{SPACE}{alone}]" if not inner else rf"[^{alone}]"
        self.split = re.compile((rf"[{alone}]|" if alone else "") + (rf"{SPACE}*{other}+|{SPACE}+" if not inner else rf"{other}+")).findall
        self.known = Remembered(lambda part: tuple(viterbi(part, self)))
        # Between single spaces every word has its own mark; its parts do not depend on what stands around it.
        self.words = Remembered(self.word) if self.prefix and not inner else None

    def word(self, word: str) -> tuple[int, ...]:
        marked = SPACE + word
        return tuple(viterbi(marked, self)) if self.alone.isdisjoint(word) and word else tuple(i for part in self.split(marked) for i in viterbi(part, self))

    def marked(self, text: str) -> str:
        """The text with space marks, as the pieces are written."""
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def matches(self, chars: str) -> Iterator[tuple[int, tuple[int | None, int, float]]]:
        """(place of the last character, (id, size, score)) of all pieces in a text, by end and falling size.

        A character that is no piece has the id None, so that every place has a match of size 1.
        """
        found = self.matcher.iter(chars) if self.ids else iter(())
        if self.single.issuperset(chars):
            return found
        alone = (None, 1, self.penalty)
        return merge(found, ((i, alone) for i, c in enumerate(chars) if c not in self.single), key=lambda m: (m[0], -m[1][1]))

    def fallback(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "replace")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


_LOW = -1e300


def viterbi(chars: str, v: Vocabulary, check_every: int = 64) -> Iterator[int]:
    """Ids of a marked text, given out as soon as they are final.

    Each position is reached by the best of the pieces that end there. What is kept is bounded by
    the longest piece and the distance between points where all surviving paths meet.
    """
    n, longest = len(chars), v.longest
    # By position, counted from what is given out already: the best sum, and the last piece with its size.
    best, sizes, piece, done = [0.0], [0], [None], 0
    top, by, back, stop = _LOW, None, 0, min(n, check_every) - 1
    for end, (found, size, score) in v.matches(chars):
        value = best[-size] + score
        if value > top:
            top, by, back = value, found, size
        if size > 1:
            continue
        # The shortest piece is the last of its position.
        best.append(top)
        sizes.append(back)
        piece.append(by)
        top = _LOW
        if end < stop:
            continue
        here = len(best) - 1
        # The latest boundary that lies on the paths of all positions from which a piece may still start.
        live = {here} if end == n - 1 else set(range(max(0, here + 1 - longest), here + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - sizes[last])
        (meet,) = live
        path, q = [], meet
        while q:
            path.append(v.fallback(chars[done + q - 1]) if piece[q] is None else (piece[q],))
            q -= sizes[q]
        for ids in reversed(path):
            yield from ids
        best, sizes, piece, done = best[meet:], sizes[meet:], piece[meet:], done + meet
        # Where the new list begins, a path ends.
        sizes[0], stop = 0, min(n - 1, end + check_every)


def encode(text: str, v: Vocabulary) -> list[int]:
    """Ids of a text. An empty text has none. Those of short parts are remembered."""
    if v.words is not None and text and "  " not in text and SPACE not in text and text[0] != " " != text[-1]:
        return list(chain.from_iterable(map(v.words.__getitem__, text.split(" "))))
    return list(chain.from_iterable(map(v.known.__getitem__, v.split(v.marked(text)))))


def decode(ids, v: Vocabulary) -> str:
    """The text behind ids; control ids stand for nothing, the unknown id for U+2047. Broken byte runs become U+FFFD."""
    text = v.text
    found = [text[i] for i in ids]
    if None not in found:
        whole = "".join(found)
        return (whole[1:] if v.prefix and whole.startswith(SPACE) else whole).replace(SPACE, " ")
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if (b := v.byte_of.get(i)) is not None:
            raw.append(b)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        if i == v.unknown:
            out.append("⁇")
        elif i not in v.control:
            out.append(v.pieces[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out)
    if v.prefix and text.startswith(SPACE):
        text = text[1:]
    return text.replace(SPACE, " ")


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_ids, decoded_sha256) of every row.

    decoded_sha256: lower-case hex of the text read back from the ids, in UTF-8; it is the text's own
    but for space marks in it, which come back as spaces. Null and empty texts have no ids. Rows
    stay one for one, repeats included. Other columns are left out.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in batches:
            for part in portions(b, 1):
                ids = [np.array(encode(t.as_py() or "", v), np.int32) for t in part.column(1)]
                back = [hashlib.sha256(decode(x.tolist(), v).encode()).hexdigest() for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(back)], names=["id", "ids", "n_ids", "decoded_sha256"])

    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, ids array<int>, n_ids long, decoded_sha256 string").withColumnRenamed("id", id_col)
