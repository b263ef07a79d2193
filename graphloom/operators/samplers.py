"""Samplers whose draws depend on each other: distractors within a budget, and covering contrast pairs."""

from __future__ import annotations

import hashlib
from bisect import insort
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import staging
from .sampling import number

POOLS = ("hard", "neighbor", "lexical", "random")


class Draws:
    """Numbers from 0 up to 1 from a digest chain: the same for the same seed and key everywhere."""

    def __init__(self, seed: int, key: str):
        self.state = hashlib.sha256(f"{seed}|{key}".encode()).digest()

    def next(self) -> float:
        self.state = hashlib.sha256(self.state).digest()
        return int.from_bytes(self.state[:6], "big") / 2**48

    def pick(self, n: int) -> int:
        return int(self.next() * n)


def sample_distractors(pools: dict[str, list[str]], ends: dict[str, tuple[str, str]], gold: set[str], target: int, weights: dict[str, float], draws: Draws) -> list[str]:
    """Units beside the gold ones, at most target, that need no further closure.

    pools: candidates by pool; ends: a relation's two nodes by its id. A relation costs itself and those
    of its ends that are missing, which then come along; one that no longer fits is passed over.
    """
    return _sample({p: list(dict.fromkeys(pools.get(p, []))) for p in POOLS}, ends, gold, target, weights, draws)


def _sample(pools: dict[str, list[str]], ends: dict[str, tuple[str, str]], gold: set[str], target: int, weights: dict[str, float], draws: Draws) -> list[str]:
    """sample_distractors() of pools without repeats, which are only read: what is drawn from one is noted by its place."""
    gone: dict[str, list[int]] = {p: [] for p in POOLS}
    have, out = set(gold), []
    while len(out) < target:
        open_ = [p for p in POOLS if len(gone[p]) < len(pools[p]) and weights.get(p, 0) > 0]
        if not open_:
            break
        at, chosen = draws.next() * sum(weights[p] for p in open_), open_[-1]
        for p in open_:
            at -= weights[p]
            if at < 0:
                chosen = p
                break
        unit = pools[chosen][_take(gone[chosen], draws.pick(len(pools[chosen]) - len(gone[chosen])))]
        if unit in have:
            continue
        added = [n for n in dict.fromkeys(ends.get(unit, ())) if n not in have] + [unit]
        if len(out) + len(added) <= target:
            out += added
            have.update(added)
    return out


def _take(gone: list[int], k: int) -> int:
    """The place of what is the k-th, from 0, without the places in gone, a sorted list that it joins."""
    for i, g in enumerate(gone):
        if g > k:
            gone.insert(i, k)
            return k
        k += 1
    gone.append(k)
    return k


def shared_distractor_udf(pools: dict[str, list[str]], ends: dict[str, tuple[str, str]], target: int, weights: dict[str, float], seed: int):
    """distractor_udf() for rows of one schema, whose pools and relations travel once with the function: a column function (key, gold)."""
    fixed = {p: list(dict.fromkeys(pools.get(p, []))) for p in POOLS}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(key: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series([_sample(fixed, ends, set(g), target, weights, Draws(seed, str(k))) for k, g in zip(key, gold)])

    return run


def distractor_udf(target: int, weights: dict[str, float], seed: int):
    """A column function (key, hard, neighbor, lexical, random, gold, relations) -> array of unit ids."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(key: pd.Series, hard: pd.Series, neighbor: pd.Series, lexical: pd.Series, random: pd.Series, gold: pd.Series, relations: pd.Series) -> pd.Series:
        rows = []
        for k, *pools, g, rs in zip(key, hard, neighbor, lexical, random, gold, relations):
            ends = {r["id"]: (r["source"], r["target"]) for r in rs}
            rows.append(sample_distractors({p: list(x) for p, x in zip(POOLS, pools)}, ends, set(g), target, weights, Draws(seed, str(k))))
        return pd.Series(rows)

    return run


def choose_pairs(rows: list[tuple[str, str, int]], n_pairs: int, draws: Draws) -> list[tuple[str, str, str]]:
    """(question, positive unit, negative unit) of n_pairs different questions that have both labels.

    Rarest units first, so that every positive unit, and then as many negative units as can be, are
    covered before questions are drawn at random. Fewer questions with both labels: fewer pairs.
    """
    by = defaultdict(lambda: ([], []))
    for question, unit, label in sorted(rows):
        by[question][1 - label].append(unit)
    by = {q: v for q, v in by.items() if v[0] and v[1]}
    count = (Counter(u for p, _ in by.values() for u in set(p)), Counter(u for _, n in by.values() for u in set(n)))
    covered: tuple[set, set] = (set(), set())
    free, out = dict(sorted(by.items())), []

    def take(question: str, positive: str) -> None:
        _, negatives = free.pop(question)
        negative = min(negatives, key=lambda u: (u in covered[1], count[1][u], u))
        covered[0].add(positive)
        covered[1].add(negative)
        out.append((question, positive, negative))

    for unit in sorted(count[0], key=lambda u: (count[0][u], u)):
        if unit not in covered[0] and len(out) < n_pairs and (own := [q for q, (p, _) in free.items() if unit in p]):
            take(own[draws.pick(len(own))], unit)
    while free and len(out) < n_pairs:
        question = list(free)[draws.pick(len(free))]
        take(question, min(free[question][0], key=lambda u: (u in covered[0], count[0][u], u)))
    return out


def _at(gone: list[int], k: int) -> int:
    """The place of what is the k-th, from 0, without the places in gone, a sorted list."""
    for g in gone:
        if g > k:
            break
        k += 1
    return k


def reachable(sizes: dict[str | None, int], n_pairs: int, draws: Draws) -> set[tuple[str | None, int]]:
    """(unit, place): where choose_pairs() may look in the sorted lists of questions with a positive unit, or of all (None).

    The t-th draw falls on a list that has lost at most t questions, so its place is known but for t. A unit of
    more than n_pairs questions is never passed over: only rarer ones, whose lists count whole, leave t open.
    """
    u = [draws.next() for _ in range(n_pairs)]
    order = sorted((c, unit) for unit, c in sizes.items() if unit is not None)
    rare = [unit for c, unit in order if c <= n_pairs]
    out = {(unit, k) for unit in rare for k in range(sizes[unit])}
    for j, (c, unit) in enumerate(order[len(rare) :]):
        for t in range(j, min(n_pairs, len(rare) + j + 1)):
            out |= {(unit, k) for k in range(int(u[t] * (c - t)), min(c, int(u[t] * c) + t + 1))}
    total = sizes.get(None, 0)
    for t in range(min(n_pairs, len(order) - len(rare)), min(n_pairs, total)):
        k = int(u[t] * (total - t))
        out |= {(None, x) for x in range(k, min(total, k + t + 1))}
    return out


def choose_listed(count: tuple[dict[str, int], dict[str, int]], total: int, listed: list[tuple[str | None, int, str]], rows: list[tuple[str, str, int]], n_pairs: int, draws: Draws) -> list[tuple[str, str, str]]:
    """choose_pairs() where only the questions that reachable() leads to are at hand.

    count: by unit, the questions with both labels that have it as positive, as negative; total: all of them; listed: (unit, place, question) of those at hand.
    """
    by, at, places, gone = defaultdict(lambda: ([], [])), {}, defaultdict(dict), defaultdict(list)
    for question, unit, label in sorted(rows):
        by[question][1 - label].append(unit)
    for unit, place, question in listed:
        at[unit, place] = question
        places[question][unit] = place
    covered: tuple[set, set] = (set(), set())
    out = []

    def drawn(unit: str | None, free: int) -> str:
        return at[unit, _at(gone[unit], draws.pick(free))]

    def take(question: str, positive: str) -> None:
        negative = min(by[question][1], key=lambda u: (u in covered[1], count[1][u], u))
        covered[0].add(positive)
        covered[1].add(negative)
        out.append((question, positive, negative))
        for unit, place in places[question].items():
            insort(gone[unit], place)

    for unit in sorted(count[0], key=lambda u: (count[0][u], u)):
        if len(out) < n_pairs and (free := count[0][unit] - len(gone[unit])):
            take(drawn(unit, free), unit)
    while len(out) < min(n_pairs, total):
        question = drawn(None, total - len(out))
        take(question, min(by[question][0], key=lambda u: (u in covered[0], count[0][u], u)))
    return out


def contrast_sample(rows: DataFrame, graph: str, question: str, unit: str, label: str, pairs_per_graph: int, seed: int) -> DataFrame:
    """Covering contrast pairs for each graph: (graph, question, positive, negative), as choose_pairs() gives them.

    The greedy choice is sequential, but looks at few questions: the sorted lists of questions of each unit are numbered by Spark, and
    what draws can reach in them, by the lists' lengths, goes to one function for each graph: about pairs_per_graph squared questions and those of
    rare units, whatever the number of rows.
    """
    text = rows.select(*[F.col(c).cast("int" if c == label else "string").alias(n) for c, n in ((graph, "g"), (question, "q"), (unit, "u"), (label, "l"))])
    both = text.groupBy("g", "q").agg(F.bool_or(F.col("l") == 1).alias("p"), F.bool_or(F.col("l") == 0).alias("n")).where("p and n")
    fit = staging.kept(text.join(both.select("g", "q"), ["g", "q"], "left_semi").distinct(), "fit")
    lists = fit.where("l = 1").select("g", "u", "q").unionByName(fit.select("g", F.lit(None).cast("string").alias("u"), "q").distinct())
    numbered = number(lists, ["g", "u", "q"])
    sizes = numbered.groupBy("g", "u").agg(F.min("i").alias("start"), F.count("*").alias("n"))

    def looked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        starts = dict(zip(pdf.u, pdf.start))
        found = reachable(dict(zip(pdf.u, pdf.n)), pairs_per_graph, Draws(seed, str(key[0])))
        return pd.DataFrame({"i": sorted(int(starts[u]) + k for u, k in found)}, dtype="int64")

    places = sizes.groupBy("g").applyInPandas(looked, "i long")
    near = staging.kept(numbered.join(places, "i").select("g", "q").distinct(), "near")
    none = lambda kind: F.lit(None).cast(kind)
    start = sizes.select(F.col("g").alias("h"), F.col("u").alias("v"), "start")
    own = numbered.join(near, ["g", "q"], "left_semi").join(start, (F.col("h") == F.col("g")) & F.col("v").eqNullSafe(F.col("u"))).select("g", "q", "u", none("int").alias("l"), (F.col("i") - F.col("start")).alias("n"))
    counted = fit.groupBy("g", "u", "l").agg(F.count("*").alias("n")).unionByName(sizes.where("u is null").select("g", "u", F.lit(1).alias("l"), "n"))
    at_hand = fit.join(near, ["g", "q"], "left_semi").withColumn("n", none("long")).unionByName(own).unionByName(counted.select("g", none("string").alias("q"), "u", "l", "n"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        count, total, listed, held = ({}, {}), 0, [], []
        for q, u, l, n in zip(pdf.q, pdf.u, pdf.l, pdf.n):
            if q is None and u is None:
                total = int(n)
            elif q is None:
                count[1 - int(l)][u] = int(n)
            elif pd.isna(n):
                held.append((q, u, int(l)))
            else:
                listed.append((u, int(n), q))
        picked = choose_listed(count, total, listed, held, pairs_per_graph, Draws(seed, str(key[0])))
        return pd.DataFrame([(key[0], *p) for p in picked], columns=[graph, question, "positive", "negative"])

    return at_hand.groupBy("g").applyInPandas(run, f"{graph} string, {question} string, positive string, negative string")


def pair_competitors(pairs: list[tuple[str, str, str]], rows: list[tuple[str, str, int]], kind: dict[str, str], competes, draws: Draws) -> tuple[list[tuple[str, str, str]], dict[str, int]]:
    """Pairs exchanged, where possible, so that the negative competes with the positive; and how many were so already, were exchanged, or have no option.

    An option keeps the kinds of both units and never takes the last place of a unit with its label.
    Options that keep the positive come first, otherwise in random order. Pairs are taken in order.
    """
    units = defaultdict(lambda: ([], []))
    for question, unit, label in sorted(set(rows)):
        units[question][1 - label].append(unit)
    held = Counter((u, 1) for _, u, _ in pairs) + Counter((u, 0) for _, _, u in pairs)
    out, stats = [], {"already": 0, "swapped": 0, "no_option": 0}
    for question, positive, negative in pairs:
        if competes(positive, negative):
            stats["already"] += 1
            out.append((question, positive, negative))
            continue
        positives, negatives = units[question]
        options = [(p, n) for p in positives for n in negatives if kind[p] == kind[positive] and kind[n] == kind[negative] and competes(p, n)]
        order = sorted(((p != positive, draws.next(), p, n) for p, n in options))
        found = next(((p, n) for _, _, p, n in order if (p == positive or held[positive, 1] > 1) and (n == negative or held[negative, 0] > 1)), None)
        stats["swapped" if found else "no_option"] += 1
        if found:
            held.subtract({(positive, 1): 1, (negative, 0): 1})
            held.update([(found[0], 1), (found[1], 0)])
        out.append((question, *(found or (positive, negative))))
    return out, stats


def paired_rows(pairs: DataFrame, rows: DataFrame, graph: str, question: str, unit: str, label: str, kind: str, seed: int) -> DataFrame:
    """pair_competitors() for each graph: (graph, question, positive, negative, competes).

    Units compete when they are of one kind and share a class of their number. Only rows of the chosen questions travel.
    """
    text = rows.select(*[F.col(c).cast("int" if c == label else "string").alias(c) for c in (graph, question, unit, label, kind)])
    chosen = text.join(pairs.select(graph, question), [graph, question], "left_semi").withColumn("negative", F.lit(None).cast("string"))
    both = pairs.select(graph, question, F.col("positive").alias(unit), F.lit(None).cast("int").alias(label), F.lit(None).cast("string").alias(kind), "negative").unionByName(chosen)
    competes = lambda p, n: int(p) % 6 == int(n) % 6 or int(p) % 10 == int(n) % 10

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf.negative.isna()]
        given = sorted(zip(*(pdf[pdf.negative.notna()][c] for c in (question, unit, "negative"))))
        kinds = dict(zip(held[unit], held[kind]))
        out, _ = pair_competitors(given, list(zip(held[question], held[unit], held[label].astype(int))), kinds, competes, Draws(seed, str(key[0])))
        return pd.DataFrame([(key[0], *p, competes(p[1], p[2])) for p in out], columns=[graph, question, "positive", "negative", "competes"])

    return both.groupBy(graph).applyInPandas(run, f"{graph} string, {question} string, positive string, negative string, competes boolean")


def rebalance(selected: dict[tuple[str, int], str], rows: list[tuple[str, str, int]], kind: dict[str, str], quota: dict[tuple[int, str], int]) -> dict[tuple[str, int], str]:
    """Units chosen anew so that each label has its quota of each kind, without leaving a covered unit uncovered.

    selected: a unit for each question and label. A question gives way only to a unit of its own with
    the scarce kind. Raises ValueError where a quota can't be met.
    """
    out, options = dict(selected), defaultdict(list)
    for question, unit, label in sorted(set(rows)):
        options[question, label].append(unit)
    held = Counter((u, label) for (_, label), u in out.items())
    for label in sorted({label for _, label in out}):
        have = Counter(kind[u] for (_, x), u in out.items() if x == label)
        want = {k: n for (x, k), n in quota.items() if x == label}
        for key in sorted(k for k in out if k[1] == label):
            unit = out[key]
            if have[kind[unit]] <= want.get(kind[unit], 0) or held[unit, label] < 2:
                continue
            scarce = [u for u in options[key] if have[kind[u]] < want.get(kind[u], 0)]
            if scarce:
                new = min(scarce, key=lambda u: (held[u, label], u))
                out[key] = new
                held.subtract([(unit, label)])
                held.update([(new, label)])
                have.subtract([kind[unit]])
                have.update([kind[new]])
        if any(have[k] != n for k, n in want.items()):
            raise ValueError(f"label {label}: quotas {want} can't be met, only {dict(have)}")
    return out
