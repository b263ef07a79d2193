"""Chat formatting by token-level assembly.

Every segment (a role, a text) is encoded on its own, with control strings taken as ordinary text;
the control ids are spliced between segments, so no text can ever produce one. Loss masks come from
prefix sums of segment lengths. Control strings that occur in content are escaped reversibly, so
that the rendered text, too, is unambiguous.

A turn is START role SEP text END. Ids from ``RESERVED`` upwards follow the tokenizer's vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<|im_start|>", "<|im_end|>")
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE = {"\\": "\\\\", "\n": "\\n"}

#: Rows of a batch that are encoded before they are handed on.
ENCODED_AT_ONCE = 500
FORMATTED = "conv_id long, turn_index long, ids array<int>, start long, loss_from long, loss_to long"


def escape(text: str) -> str:
    """One more backslash after the < of anything that reads as a (possibly escaped) control string."""
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    """As escape(); a line feed, which ends the header of a rendered turn, is written \\n."""
    return re.sub(r"[\\\n]", lambda m: _ROLE[m[0]], role).replace("<|", "<\\|")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role.replace("<\\|", "<|"))


_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once for each worker."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        _LOADED[path] = found
    return _LOADED[path]


def _ids(text: str, tokenizer) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids


def reserved(tokenizer) -> tuple[int, int, int]:
    """Ids of START, SEP and END, the first three after the vocabulary."""
    n = tokenizer.get_vocab_size()
    return n, n + 1, n + 2


def format_turns(turns: DataFrame, tokenizer_path: str, loss_role: str = "assistant", partitions: int | None = None) -> DataFrame:
    """One row per turn (FORMATTED), sorted by conversation and turn within each partition.

    turns: conv_id, turn, role, text; other columns are ignored. start is the position of the
    turn's first id in its conversation; loss_from and loss_to bound the ids under the loss mask
    (equal: none). Null roles and texts are empty; rows of one conversation with the same turn are
    ordered by role and a hash of the text; rows without conv_id form one conversation of id null.
    No turns: no rows. Texts are encoded where they lie; after that one shuffle brings together the
    ids of a conversation, which are then read as a stream, turn by turn, and never gathered.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load_tokenizer(tokenizer_path)
        begin, sep, end = reserved(t)
        for b in batches:
            for at in range(0, len(b), ENCODED_AT_ONCE):
                part = b.iloc[at : at + ENCODED_AT_ONCE]
                roles = [_ids(x, t) for x in map(escape_role, part.role)]
                yield pd.DataFrame({
                    "conv_id": part.conv_id, "turn": part.turn, "role": part.role, "text_key": part.text_key,
                    "ids": [np.array([begin, *r, sep, *_ids(escape(x), t), end], np.int32) for r, x in zip(roles, part.text)],
                    "n_role": [len(r) for r in roles],
                })

    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The text itself need not travel: its hash orders repeated turns alike on every run.
    encoded = clean.withColumn("text_key", F.xxhash64("text")).mapInPandas(encode, "conv_id long, turn long, role string, text_key long, ids array<int>, n_role int")
    by = encoded.repartition(partitions, "conv_id") if partitions else encoded.repartition("conv_id")
    ordered = by.sortWithinPartitions("conv_id", "turn", "role", "text_key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, at = (), 0, 0
        for b in batches:
            conv, role = b.column("conv_id").to_pylist(), b.column("role").to_pylist()
            size, n_role = pa.compute.list_value_length(b.column("ids")).to_pylist(), b.column("n_role").to_pylist()
            rows = []
            for c, r, n, k in zip(conv, role, size, n_role):
                if (c,) != last:
                    last, index, at = (c,), 0, 0
                lo = at + k + 2
                rows.append((index, at, lo, at + n - 1 if r == loss_role else lo))
                index, at = index + 1, at + n
            i, s, f, t = (pa.array([x[j] for x in rows], pa.int64()) for j in range(4))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), i, b.column("ids"), s, f, t], names=["conv_id", "turn_index", "ids", "start", "loss_from", "loss_to"])

    return ordered.mapInArrow(place, FORMATTED)


def decode(ids: list[int], tokenizer) -> str:
    return tokenizer.decode(ids, skip_special_tokens=False)


def parse_turn(ids: list[int], start: int, loss_from: int, loss_to: int, tokenizer) -> tuple[str, str, str, str]:
    """(role, text, text under the loss mask, rendered turn), the first three unescaped, from a turn's ids."""
    begin, sep, end = reserved(tokenizer)
    cut = ids.index(sep)
    if ids[0] != begin or ids[-1] != end or max(ids[1:cut] + ids[cut + 1 : -1], default=0) >= begin:
        raise ValueError("not a formatted turn")
    role, text = decode(ids[1:cut], tokenizer), decode(ids[cut + 1 : -1], tokenizer)
    lo, hi = loss_from - start, loss_to - start
    loss = text if (lo, hi) == (cut + 1, len(ids) - 1) else decode(ids[lo:hi], tokenizer)
    return unescape_role(role), unescape(text), unescape(loss), f"{CONTROL[0]}{role}\n{text}{CONTROL[1]}\n"


def read_turns(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Turns read back from format_turns: role, text, loss_text (what stands under the mask) and rendered by turn."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load_tokenizer(tokenizer_path)
        for b in batches:
            rows = [parse_turn(list(map(int, ids)), *x, t) for ids, *x in zip(b.ids, b.start, b.loss_from, b.loss_to)]
            yield pd.DataFrame({"conv_id": b.conv_id, "turn_index": b.turn_index} | {k: [r[i] for r in rows] for i, k in enumerate(("role", "text", "loss_text", "rendered"))})

    return formatted.mapInPandas(read, "conv_id long, turn_index long, role string, text string, loss_text string, rendered string")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_turns(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation (DIGEST), read back from format_turns, on whose order within partitions it relies.

    Turns are decoded and hashed one after another: a conversation of any length is never gathered.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load_tokenizer(tokenizer_path)
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if "sha256" in x else pa.int64() for x in names]
        open_: list | None = None
        close = lambda x: (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
        for b in batches:
            done = []
            column = {n: b.column(n) for n in ("conv_id", "turn_index", "ids", "start", "loss_from", "loss_to")}
            for i in range(b.num_rows):
                conv_id, turn_index, ids, start, lo, hi = (c[i].as_py() for c in column.values())
                role, text, loss, rendered = parse_turn(ids, start, lo, hi, t)
                if turn_index == 0:
                    if open_:
                        done.append(close(open_))
                    open_ = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(loss)
                open_[4].update(loss.encode())
                open_[5] += len(rendered)
            if done:
                yield as_batch(done)
        if open_:
            yield as_batch([close(open_)])

    return formatted.mapInArrow(digest, DIGEST)
