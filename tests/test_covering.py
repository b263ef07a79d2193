"""Covering choices against loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import covering


def draw(seed, *keys):
    return hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()


def loop_choose(rows, seed, turn=None):
    units, f = {}, {}
    for e, u in set(rows):
        units.setdefault(e, []).append(u)
        f[u] = f.get(u, 0) + 1
    taken, out = set(), []
    for e in sorted(units, key=lambda e: (draw(seed, e) if turn is None else turn(e), e)):
        u = min(units[e], key=lambda u: (u in taken, f[u], draw(seed, e, u), u))
        out.append((e, u, u not in taken))
        taken.add(u)
    return sorted(out)


def loop_cover(rows, seed):
    examples = {}
    for e, u in set(rows):
        examples.setdefault(u, []).append(e)
    used, out = set(), []
    for u in sorted(examples, key=lambda u: (len(examples[u]), u)):
        if free := [e for e in examples[u] if e not in used]:
            e = min(free, key=lambda e: (draw(seed, e, u), e))
            used.add(e)
            out.append((e, u))
    return sorted(out)


def cases():
    for seed, n, units, most in ((1, 200, 40, 6), (2, 60, 200, 9), (3, 300, 5, 3), (4, 50, 1, 1)):
        r = random.Random(seed)
        rows = [(e, min(int(r.expovariate(1.5) * units / 3), units - 1)) for e in range(n) for _ in range(r.randint(1, most))]
        yield rows + rows[:5]
    # A chain: each example prefers what the one before it has.
    yield [(i, i) for i in range(25)] + [(i, i + 1) for i in range(25)]


@pytest.mark.parametrize("rows", list(cases()))
@pytest.mark.parametrize("parts", [1, 7])
def test_choices_are_those_of_a_loop(spark, rows, parts):
    df = spark.createDataFrame(rows, "e int, u int").repartition(parts)
    got = covering.choose(df, ["e"], ["u"], 9).collect()
    assert sorted((r.e, r.u, r.first) for r in got) == loop_choose(rows, 9)
    assert sorted((r.e, r.u) for r in covering.cover(df, ["e"], ["u"], 9).collect()) == loop_cover(rows, 9)


def test_every_coverable_unit_is_covered_and_the_rest_named(spark):
    rows = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 3), (2, 2)]
    df = spark.createDataFrame(rows, "e int, u int")
    got = covering.cover(df, ["e"], ["u"], 1)
    assert sorted(r.u for r in got.collect()) == [0, 2, 3]
    assert [r.u for r in covering.uncovered(df, got, ["u"]).collect()] == [1]


def test_no_rows_and_an_order_of_turns(spark):
    df = spark.createDataFrame([], "e int, u int")
    assert covering.choose(df, ["e"], ["u"], 1).count() == 0 and covering.cover(df, ["e"], ["u"], 1).count() == 0
    rows = [(e, u) for e in range(12) for u in range(e % 4, 6)]
    got = covering.choose(spark.createDataFrame(rows, "e int, u int"), ["e"], ["u"], 3, -F.col("e")).collect()
    assert sorted((r.e, r.u, r.first) for r in got) == loop_choose(rows, 3, lambda e: -e)


def loop_contrast(rows, n_pairs, seed):
    out = []
    for g in sorted({r[0] for r in rows}):
        of = {}
        for _, e, u, label in {r for r in rows if r[0] == g}:
            of.setdefault(e, ([], []))[1 - label].append(u)
        of = {e: x for e, x in of.items() if x[0] and x[1]}
        if not of:
            continue
        key = lambda e: (g, e)
        f = {}
        for p, _ in of.values():
            for u in p:
                f[u] = f.get(u, 0) + 1
        taken, used = [], {}
        for u in sorted(f, key=lambda u: (f[u], u)):
            if free := [e for e in of if u in of[e][0] and e not in used]:
                e = min(free, key=lambda e: (draw(seed, g, e, g, u), e))
                used[e] = u
                taken.append((0, e))
        more = sorted((e for e in of if e not in used), key=lambda e: (draw(seed, g, e), e))[: max(0, n_pairs - len(used))]
        for e in more:
            used[e] = min(of[e][0], key=lambda u: (f[u], draw(seed, g, e, u), u))
            taken.append((1, e))
        fn = {}
        for _, e in taken:
            for u in of[e][1]:
                fn[u] = fn.get(u, 0) + 1
        covered = set()
        for _, e in sorted(taken, key=lambda x: (x[0], draw(seed + 1, g, x[1]), x[1])):
            u = min(of[e][1], key=lambda u: (u in covered, fn[u], draw(seed, g, e, g, u), u))
            covered.add(u)
            out.append((g, e, used[e], u))
    return sorted(out)


@pytest.mark.parametrize("n_pairs", [0, 8, 25, 1000])
def test_contrast_pairs_are_those_of_a_loop(spark, n_pairs):
    r = random.Random(12)
    rows = [(f"g{e % 3}", e, u, int(r.random() < 0.4)) for e in range(120) for u in r.sample(range(14), r.randint(1, 5))]
    df = spark.createDataFrame(rows, "graph string, example int, unit int, label int")
    got = sorted(tuple(x) for x in covering.contrast_cover(df, "graph", "example", "unit", "label", n_pairs, 5).collect())
    assert got == loop_contrast(rows, n_pairs, 5)
    positives = {(g, u) for g, e, u, label in rows if label == 1 and any(x[:2] == (g, e) and x[3] == 0 for x in rows)}
    if n_pairs >= 25:
        assert {(g, p) for g, _, p, _ in got} == positives
