"""The audit against filters that are run one after the other."""

import random
import re
from itertools import permutations

from graphloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, id string, part int, bits string, digest string"
LABELS = "doc_id long, quality int, toxic int, n string, good string"


def truth(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > least[t],
        }
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                failing = sum(r[1][x] for r in mine)
                removed_by[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), x))
        out += [(*f[:-1], removed_by[f[-1]]) for f in found]
    return sorted(out)


def run(spark, docs, labels):
    a = spark.createDataFrame([(*d, "clash", 1, "clash", "clash") for d in docs], DOCS)
    b = spark.createDataFrame([(*x, "clash", "clash") for x in labels], LABELS)
    got = filter_audit.audit(a, b).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r) for r in got.collect())


def test_every_order_against_filters_run_in_turn(spark):
    r = random.Random(8)
    docs = []
    for i in range(160):
        n = r.choice([0, 1, 50, 199, 200, 201, 400])
        w = [r.choice(["alpha", "beta", "É", "日本"]) + (str(r.randrange(1000)) if r.random() < r.choice([0.2, 0.9]) else "") for _ in range(n)]
        t = r.choice([" ", "\n", " \t", "\x0b"]).join(w) + r.choice(["", "", " #", " |", " A" * 9, "ABCDEFG" * r.randint(0, 30)])
        docs.append((i, t, r.choice(["en", "de", "", None])))
    docs += [(200 + i, docs[r.randrange(160)][1], r.choice(["en", "de"])) for i in range(60)]
    docs += [(300, None, "en"), (301, "", "de"), (None, docs[3][1], "en"), (None, None, None), (7, docs[7][1], "fr"), (7, docs[8][1], "en"), (302, "x " * 30000, "en"), (-1, docs[5][1], "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(-1, 260, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == truth(docs, labels)


def test_bounds_of_the_conditions(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (199, 200)]
    texts += [" ".join(["x", "y"] * 100 + [f"w{i}" for i in range(n)]) for n in (196, 197)]
    texts += ["A" * 3 + "a" * 97, "A" * 4 + "a" * 96, "ÀÉ" * 50, "&", "$", "%", "*", "|", "#", "+"]
    docs = [(i, t, "en") for i, t in enumerate(texts)]
    assert run(spark, docs, []) == truth(docs, [])


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    one = run(spark, [(1, None, None)], [])
    assert len(one) == 600 and {x[0] for x in one} == {""}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([], DOCS)
    plan = filter_audit.masks(docs)._jdf.queryExecution().toString() + docs.select(*filter_audit.failures(docs.text).values())._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
