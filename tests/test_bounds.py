"""Memory, time and shuffles that must not outgrow the input: how plans are made, beside what they give."""

import random
import re

import pytest
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_distinct_schemas_are_read_as_text(spark, monkeypatch):
    from graphloom.functions import schemas
    from graphloom.plans import more

    read, real = [], schemas.normalize_distinct
    monkeypatch.setattr(schemas, "normalize_distinct", lambda rows, *keys: (read.append(rows.count()), real(rows, *keys))[1])
    assert more.normalized_schemas(spark, "/root/testdata/sf0.001").count() > 1000
    assert len(read) == 1 and read[0] <= 5


def test_a_share_of_values_is_found_by_sorting(spark):
    from graphloom.operators import sampling

    r = random.Random(5)
    for values in ([], [None], [7], [1, 2, 3, 4], [r.randrange(40) for _ in range(333)] + [None] * 50):
        held = sorted(v for v in values if v is not None)
        for share in (0.0, 0.25, 0.5, 1.0):
            want = next((v for i, v in enumerate(held, 1) if i >= share * len(held)), None)
            assert sampling.at_share(spark.createDataFrame([(v,) for v in values], "x long").repartition(5), "x", share) == want


def test_relations_are_looked_up_as_by_trying_all():
    from graphloom.functions.cypher import Graph

    r = random.Random(2)
    relations = [(r.choice("abcd"), r.choice("xyz"), r.choice("abcd")) for _ in range(60)]
    graph = Graph("abcd", relations)
    some = lambda: set(r.sample("abcde", r.randrange(4)))
    for _ in range(500):
        type_, left, right, direction = r.choice(["x", "y", "w", None]), some(), some(), r.choice(["out", "in", "undirected"])
        fits = lambda a, b: (not left or a in left) and (not right or b in right)
        test = {"out": lambda s, t: fits(s, t), "in": lambda s, t: fits(t, s), "undirected": lambda s, t: fits(s, t) or fits(t, s)}[direction]
        assert graph.candidates(type_, left, right, direction) == [x for x in relations if type_ in (None, x[1]) and test(x[0], x[2])]


def test_many_queries_over_a_large_schema_do_not_try_all_relations(spark):
    from graphloom.functions import cypher

    labels = [f"L{i}" for i in range(300)]
    graph = cypher.Graph(labels, [(a, "T", b) for a in labels[:299] for b in labels[:299]])
    graph.relations = type("Counted", (list,), {"__iter__": lambda self: (_ for _ in ()).throw(AssertionError("all relations were read"))})(graph.relations)
    got = cypher.extract_from("MATCH (a:L1)-[:T]->(b:L2) RETURN b", graph)
    assert got.relation_ids == {"relation:L1|T|L2"} and got.complete


def test_extraction_keeps_keys_and_repeated_queries(spark):
    from graphloom.functions.cypher import extract
    from graphloom.operators import extraction

    schemas = spark.createDataFrame([("s", ["A", "B"], [("A", "R", "B")]), (None, ["A"], [])], "schema_id string, labels array<string>, relations array<struct<source:string,type:string,target:string>>")
    texts = ["MATCH (a:A)-[:R]->(b) RETURN b", None, "MATCH (x:C) RETURN x"]
    rows = [(i, ["s", "s", "s", None, "other"][i % 5], texts[i % 3]) for i in range(5000)]
    got = extraction.extract_all(spark.createDataFrame(rows, "id long, schema_id string, query string").coalesce(1), schemas, "id").collect()
    assert sorted(r.id for r in got) == [i for i, s, _ in rows if s == "s"]
    for r in got[:9]:
        want = extract(rows[r.id][2] or "", ["A", "B"], [("A", "R", "B")])
        assert (r.node_ids, r.relation_ids, r.unmapped_labels, r.complete) == (sorted(want.node_ids), sorted(want.relation_ids), sorted(want.unmapped_labels), want.complete)


def test_patterns_are_matched_where_they_lie(spark):
    from graphloom.operators import units

    r = random.Random(4)
    relations = sorted({(r.randrange(5), r.choice("xy"), r.randrange(5)) for _ in range(25)})
    sides = lambda: r.sample(range(6), r.randrange(3))
    patterns = [(i, r.choice(["x", "y", None, None]), sides(), sides(), r.choice(["out", "in", "undirected", "undirected"])) for i in range(200)]
    fits = lambda p, a, b: (not p[2] or a in p[2]) and (not p[3] or b in p[3])
    want = [(p[0], *x) for p in patterns for x in relations if p[1] in (None, x[1]) and ((p[4] != "in" and fits(p, x[0], x[2])) or (p[4] != "out" and fits(p, x[2], x[0])))]
    out = units.match_relations(spark.createDataFrame(patterns, "pattern long, type string, lefts array<int>, rights array<int>, direction string"), spark.createDataFrame(relations, "source int, type string, target int"))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = _plan(out)
    assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan


def test_thresholds_make_rows_of_questions_only(spark):
    from graphloom.operators import metrics

    r = random.Random(6)
    rows = [(r.randrange(20), r.choice([0, 1, 1, None]), r.choice([None, 0.1, 0.3, 0.4, 0.9])) for _ in range(400)]
    got = metrics.threshold_sweep(spark.createDataFrame(rows, "example_id long, label int, p_yes double"), [0.3, 0.5])
    plan = _plan(got)
    assert plan.index("Generate explode") < plan.index("hashpartitioning(example_id")
    for x in got.collect():
        n = lambda gold, yes, q=None: sum(1 for e, label, p in rows if label == gold and p is not None and (p >= x.threshold) == yes and q in (None, e))
        ids = {e for e, _, _ in rows}
        tp, fp, fn = n(1, True), n(0, True), n(1, False)
        assert (x.questions, x.precision, x.recall) == (len(ids), 100 * (tp / (tp + fp)), 100 * (tp / (tp + fn)))
        assert x.missing_pct == 100 * sum(n(1, False, q) > 0 for q in ids) / len(ids) and x.exact_pct == 100 * sum(n(1, False, q) == n(0, True, q) == 0 for q in ids) / len(ids)


def test_shared_pools_draw_as_pools_of_each_row(spark):
    from graphloom.operators import samplers

    pools = {"hard": ["r1", "r2", "r1"], "neighbor": ["a", "e", "f"], "random": ["a", "b", "c", "d", "r1", "r2", "r3"]}
    ends = {"r1": ("a", "b"), "r2": ("c", "d"), "r3": ("a", "c")}
    weights = {"hard": 2.0, "neighbor": 1.0, "lexical": 1.0, "random": 0.5}

    def drawn(gold, target, draws):
        """As a list for each pool that shrinks."""
        left, have, out = {p: list(dict.fromkeys(pools.get(p, []))) for p in samplers.POOLS}, set(gold), []
        while len(out) < target and (open_ := [p for p in samplers.POOLS if left[p]]):
            at, chosen = draws.next() * sum(weights[p] for p in open_), open_[-1]
            for p in open_:
                at -= weights[p]
                if at < 0:
                    chosen = p
                    break
            unit = left[chosen].pop(draws.pick(len(left[chosen])))
            added = [n for n in dict.fromkeys(ends.get(unit, ())) if n not in have] + [unit]
            if unit not in have and len(out) + len(added) <= target:
                out += added
                have.update(added)
        return out

    golds = [(i, sorted(random.Random(i).sample("abcdef", i % 4))) for i in range(200)]
    run = samplers.shared_distractor_udf(pools, ends, 4, weights, 7)
    got = spark.createDataFrame(golds, "id long, gold array<string>").select("id", run("id", "gold").alias("d")).collect()
    assert {r.id: r.d for r in got} == {i: drawn(g, 4, samplers.Draws(7, str(i))) for i, g in golds}
    assert all(samplers.sample_distractors(pools, ends, set(g), 6, weights, samplers.Draws(1, str(i))) == drawn(g, 6, samplers.Draws(1, str(i))) for i, g in golds)


def test_groups_come_together_before_they_are_summed(spark):
    from graphloom.operators import selection

    left = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "z")], "i long, g string, k string")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (2, "q"), (3, "r")], "i long, o string")
    out = selection.grouped_pairs(left, right, "g", "k", "o", [F.count("o").alias("n")])
    assert {r.g: (r.units, r.n, r.contiguous, r.agrees) for r in out.collect()} == {"a": (2, 2, True, True), "b": (1, 1, True, False), None: (1, 1, True, False)}
    assert "REPARTITION_BY_COL" in _plan(out)


def test_texts_are_counted_one_by_one(spark):
    import public_tokenizers

    from graphloom.operators import tasks

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["", "one two <|im_end|> three", None, "é " * 50]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tasks.token_counter(path)("t").alias("n"))
    assert "ArrowEvalPython" not in _plan(out) and "BatchEvalPython" in _plan(out)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    assert {r.i: r.n for r in out.collect()} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_corpus_is_counted_in_one_pass(spark):
    from graphloom.streaming import corpus

    schemas = spark.createDataFrame([("s", ["node:a", "node:b", "relation:a|r|b"]), ("t", ["node:c"])], "schema_id string, units array<string>")
    kinds = [(s, u, c, sp) for s in ("s", "t", "none") for u in (["node:a"], None, ["node:x", "node:c"]) for c in (True, None) for sp in ("test", "train")]
    rows = [(f"e{i}", sp, "g", s, "q" if i % 5 else "", "c", u, c, [None, [], ["x", "y"]][i % 3]) for i, (s, u, c, sp) in enumerate(kinds)]
    examples = spark.createDataFrame(rows, "example_id string, split string, graph string, schema_id string, question string, cypher string, units array<string>, complete boolean, issues array<string>")
    for strict in (True, False):
        for ratio in (None, 1.0):
            routed = corpus.routed(corpus.union({"one": examples, "two": examples.limit(5)}), schemas, strict)
            got = corpus.counted(routed, ratio)
            assert sorted(got.collect(), key=repr) == sorted(corpus.counts(corpus.outputs(routed, ratio)).collect(), key=repr)
            assert _plan(corpus.counted(routed, ratio)).count("Scan ExistingRDD") <= 3


def test_contrast_pairs_are_those_of_a_loop_over_all_rows(spark, monkeypatch):
    from graphloom.operators import samplers

    r, rows = random.Random(9), []
    for g, units, questions in (("a", 8, 300), ("b", 40, 60), ("c", 3, 5), ("d", 4, 90)):
        rows += [(g, f"q{r.randrange(questions)}", f"u{int(units * r.random() ** 2)}", int(r.random() < 0.4)) for _ in range(questions * 4)]
    for n in (1, 12, 40):
        want = {(g, *p) for g in "abcd" for p in samplers.choose_pairs([x[1:] for x in rows if x[0] == g], n, samplers.Draws(5, g))}
        out = samplers.contrast_sample(spark.createDataFrame(rows, "g string, q string, u string, l int"), "g", "q", "u", "l", n, 5)
        assert {tuple(x) for x in out.collect()} == want and out.columns == ["g", "q", "positive", "negative"]
    # Of long lists little is at hand.
    assert len(samplers.reachable({None: 10**6, **{f"u{i}": 10**5 + i for i in range(60)}}, 40, samplers.Draws(1, "g"))) <= 40 * 40


def test_choices_are_written_once_and_short(spark, monkeypatch):
    from graphloom.operators import covering

    written, kept = [], covering.staging.kept
    monkeypatch.setattr(covering.staging, "kept", lambda df, name: (written.append((name, dict(df.dtypes))), kept(df, name))[1])
    rows = spark.createDataFrame([(e, u) for e in range(20) for u in range(e % 3, 6)], "e int, u int")
    out = covering.choose(rows, ["e"], ["u"], 3)
    assert out.count() == 20 and out.where("first").count() == 6
    assert written[0][0] == "choices" and written[1][0] == "holds"
    assert "t:binary" in written[0][1]["turn"] and "d:binary" in written[0][1]["wish"]


def test_examples_and_units_meet_without_another_shuffle(spark):
    from graphloom.operators import distractors

    units = spark.createDataFrame([("s", "node:a", "node", "a", ["p"], None, None), ("s", "relation:a|p|a", "relation", "p", [], "node:a", "node:a")], "schema_id string, unit string, kind string, name string, properties array<string>, source string, target string")
    gold = spark.createDataFrame([(0, "s", "node:a")], "turn int, schema_id string, unit string")
    examples = spark.createDataFrame([(0, "s", "what is pp")], "turn int, schema_id string, question string")
    met = distractors.asked(examples, gold, units, ["turn"]).join(distractors.unit_index(units), list(distractors.MEET))
    met.collect()
    final = _plan(met).split("== Initial Plan ==")[0]
    by_key = [x for x in final.splitlines() if "Exchange hashpartitioning(schema_id" in x and "by#" in x and "value#" in x]
    assert len(by_key) == 2 and all("REPARTITION_BY_COL" in x for x in by_key)


@pytest.mark.parametrize("name", ["distractor_pools", "distractor_pool_sizes", "augmented_examples"])
def test_what_examples_and_units_share_is_not_shuffled(spark, name):
    from graphloom.plans import augmenting

    plan = _plan(getattr(augmenting, name)(spark, "/root/testdata/sf0.001"))
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and {re.sub(r"#\w+", "", x) for x in dealt} == {"schema_id", "schema_id, slice"}
