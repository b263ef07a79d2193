"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from graphloom.llm import spelling

DOCS = "doc_id long, text string, id string, word string, n int, run string"


def near(a, b):
    """Whether one inserted, deleted or replaced code point parts two different words."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs, slip=199):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if slip and h % slip == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def truth(n):
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed, letters, n_words, n_docs=60):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n_words)]

    def changed(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w + r.choice(letters)])

    pool = base + [changed(w) for w in base for _ in range(4)]
    pool += [changed(w) for w in pool[::3]]
    weight = [r.choice([1, 1, 3, 20, 120]) for _ in pool]
    docs = [(i, r.choice([" ", ", ", "1", "\n"]).join(w.capitalize() if r.random() < 0.2 else w for w in r.choices(pool, weight, k=400))) for i in range(n_docs)]
    return docs + [(900, None), (901, ""), (902, "... 77"), (None, docs[0][1]), (4, docs[4][1]), (903, ("mmmmmmm nnnnnnnn mmmmmmmm " * 2000) + "a" * 30000 + " " + ("b" * 5000 + " ") * 6)]


@pytest.mark.parametrize("seed, letters, n_words", [(1, "abcdefghijklmnopqrstuvwxyz", 60), (2, "ab", 40), (3, "aé÷ÿb", 50), (4, "aaab", 30)])
def test_groups_against_all_pairs(spark, seed, letters, n_words):
    docs = corpus(seed, letters, n_words)
    df = spark.createDataFrame([(i, t, "clash", "clash", 1, "clash") for i, t in docs], DOCS)
    got = rows(spelling.spelling_variants(df))
    assert got == truth(counted(docs))
    assert any(f for _, f, *_ in got)


def test_letters_go_where_the_checksum_says(spark):
    docs = [(i, "wonderful Öffnung STRASSE übermut " * 5) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for slip in (199, 3, 1, None):
        got = {r.word: r.n for r in spelling.vocabulary(df, slip=slip).collect()}
        assert got == counted(docs, slip)


def test_forms_chain_to_the_last_and_ties_go_to_the_smaller(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 5, "zzzzzy": 30, "zzzzzx": 30, "qqqqqq": 24, "qqqqqr": 5}
    got = rows(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == truth(n)
    by = {x[0]: x for x in got}
    assert by["aaaaaa"][2] == "abbbbb" and by["zzzzzz"][1] == "zzzzzx" and by["qqqqqr"][1] is None


def test_words_of_one_frequent_bigram_do_not_meet_in_one_group(spark):
    """All words share bigrams and length; halves part them."""
    r = random.Random(5)
    n = {"ab" + "".join(r.choice("cdefgh") for _ in range(8)): 5 + r.randrange(500) for _ in range(1500)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows(spelling.group_variants(df)) == truth(n)
    keyed = spelling._keyed(spelling.rarest_bigrams(df), False)
    largest = keyed.groupBy("length", "gram", "at", "side", "half").count().agg({"count": "max"}).first()[0]
    assert largest < len(n) / 20


def test_empty_tables_and_bad_factor(spark):
    assert rows(spelling.spelling_variants(spark.createDataFrame([], DOCS))) == []
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), factor=1)


def test_only_the_order_of_bigrams_is_broadcast(spark, monkeypatch):
    """Kept tables look small to Spark, whatever they explode to: only the bigrams, at most 90 * 90, may pass through the driver."""
    plans, keep = [], spelling.scratch.keep

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(spelling.scratch, "keep", seen)
    words = spark.createDataFrame([("abcdef", 90), ("abcdeg", 9), ("abcdefg", 5)], "word string, n long")
    out = spelling.group_variants(words)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.word: r.form for r in out.collect()} == {"abcdef": None, "abcdeg": "abcdef", "abcdefg": "abcdef"}
    assert sum(p.count("BroadcastHashJoin") for p in plans) == 1 and sum(p.count("SortMergeJoin") for p in plans) >= 6
