"""Decontamination against every window of every text."""

import random
import re

import pytest

from graphloom.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row string, hits string, n_words int, span string"
ITEMS = "item_id long, text string, fp string, doc_id long"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def truth(docs, items, length):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), length)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= at
        spans = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((d, len(w), list(zip(*spans)), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def run(spark, docs, items, length=10):
    a = spark.createDataFrame([(i, t, "clash", "clash", 1, "clash") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "clash", 7) for i, t in items], ITEMS)
    rows = winnow.decontaminate(a, b, length).collect()
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.spans], r["items"]) for r in rows), key=repr)


def cases(seed, size):
    r = random.Random(seed)
    some = [f"w{i}" for i in range(size)] + ["é", "ß1", "日本", "7"]
    items = [(i, " ".join(r.choice(some) for _ in range(r.choice([1, 2, 3, 5, 9, 10, 11, 40])))) for i in range(30)]
    items += [(30, items[5][1].upper()), (31, None), (32, ""), (33, "-- !"), (None, items[7][1]), (5, items[5][1]), (5, items[6][1])]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += [r.choice(some) for _ in range(r.randint(0, 15))]
            w = (r.choice(items)[1] or "").split()
            lo = r.randint(0, max(0, len(w) - 5))
            parts += w[lo : lo + r.choice([9, 10, 12, 100])]
        docs.append((d, r.choice([" ", "\n", "-", "_"]).join(parts)))
    docs += [(80, None), (81, ""), (82, "!?"), (None, items[9][1]), (3, docs[3][1]), (3, docs[4][1]), (83, "a_b " * 9000 + items[8][1]), (84, items[8][1] * 3)]
    return docs, items


@pytest.mark.parametrize("seed, size, length", [(1, 200, 10), (2, 2, 10), (3, 3, 4), (4, 30, 1), (5, 5, 13)])
def test_every_window_is_found(spark, seed, size, length):
    docs, items = cases(seed, size)
    assert run(spark, docs, items, length) == truth(docs, items, length)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Marks say what may occur, the join says what does."""
    monkeypatch.setattr(winnow, "bitmap", lambda windows: winnow.np.full(winnow.BITS // 8, 255, "uint8"))
    docs, items = cases(6, 40)
    assert run(spark, docs, items) == truth(docs, items, 10)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b"), (2, None)], []) == [(1, 2, [], []), (2, 0, [], [])]


def test_equal_windows_keep_equal_fingerprints_wherever_they_stand():
    r = winnow.np.random.default_rng(3)
    w = r.integers(0, 3, 500).astype("uint64")
    owner, start, fp = winnow.windows_of(w, winnow.np.array([200, 0, 7, 293]), 10)
    seen = {}
    first = [0, 200, 200, 207]
    for o, s, f in zip(owner, start, fp):
        assert seen.setdefault(tuple(w[first[o] + s : first[o] + s + 10]), f) == f
    assert sorted(zip(owner.tolist(), start.tolist())) == [(0, i) for i in range(191)] + [(3, i) for i in range(284)]
