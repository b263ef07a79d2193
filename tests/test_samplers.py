import random

from graphloom.functions.provenance import provenance
from graphloom.operators.samplers import Draws, choose_pairs, sample_distractors


def test_provenance():
    got = provenance("MATCH (:Crew)-[:SERVES]->(s:Ship {flag: 'no'}) WHERE s.age > 9 RETURN count(s)", "rid")
    assert got == (
        "MATCH (ntmp0:Crew)-[rtmp0:SERVES]->(s:Ship {flag: 'no'}) WHERE s.age > 9 WITH collect(distinct elementId(ntmp0)) + collect(distinct elementId(s)) AS elemIds "
        "UNWIND elemIds AS elemId RETURN elemId AS rid"
    )
    assert provenance("match (s:Ship) return s", "rid") == "UNWIND [] AS elemId RETURN elemId AS rid"
    assert provenance("MATCH (a:A) RETURN a UNION MATCH (b:B) RETURN b").count(" UNION ") == 1
    assert provenance("MATCH (a:A) WITH a MATCH (a)-[r]->(b) WHERE b.x = 1 RETURN b").startswith("MATCH (a:A) WITH * MATCH (a)-[r]->(b) WHERE b.x = 1 WITH collect")
    assert provenance("MATCH (a:A) WITH a.x AS x MATCH (c) RETURN c").startswith("MATCH (a:A) WITH collect(distinct elementId(a)) AS")
    assert provenance("CALL { MATCH (a:A) RETURN a UNION MATCH (b:B) RETURN b } RETURN a").count("MATCH") == 2


def test_distractors_stay_in_budget_and_closed():
    ends = {"r1": ("a", "b"), "r2": ("c", "d"), "r3": ("a", "c")}
    pools = {"hard": ["r1", "r2"], "random": ["a", "b", "c", "d", "r1", "r2", "r3"]}
    for seed in range(50):
        for target in range(6):
            out = sample_distractors(pools, ends, {"a"}, target, {"hard": 1.0, "random": 1.0}, Draws(seed, "k"))
            assert len(out) == len(set(out)) <= target and "a" not in out
            assert all(n in {*out, "a"} for u in out for n in ends.get(u, ()))
            assert out == sample_distractors(pools, ends, {"a"}, target, {"hard": 1.0, "random": 1.0}, Draws(seed, "k"))
    assert sample_distractors({}, {}, set(), 3, {"hard": 1.0}, Draws(1, "k")) == []


def test_pairs_cover_rare_units_and_use_each_question_once():
    r = random.Random(3)
    rows = [(f"q{q}", f"u{r.randrange(12)}", int(r.random() < 0.4)) for q in range(60) for _ in range(6)]
    out = choose_pairs(rows, 25, Draws(1, "g"))
    questions = {q for q, _, _ in rows}
    both = {q for q in questions if {label for x, _, label in rows if x == q} == {0, 1}}
    assert len(out) == min(25, len(both)) and len({q for q, _, _ in out}) == len(out) and {q for q, _, _ in out} <= both
    assert all((q, p, 1) in rows and (q, n, 0) in rows for q, p, n in out)
    assert {p for _, p, _ in out} == {u for q, u, label in rows if label == 1 and q in both}


def test_competitors_are_exchanged_without_losing_cover():
    from graphloom.operators.samplers import pair_competitors

    kind = {"a": "node", "b": "node", "c": "node", "x": "node", "y": "node"}
    competes = lambda p, n: (p, n) in {("a", "x"), ("b", "y")}
    rows = [("q1", "a", 1), ("q1", "x", 0), ("q1", "y", 0), ("q2", "b", 1), ("q2", "y", 0), ("q3", "c", 1), ("q3", "x", 0)]
    out, stats = pair_competitors([("q1", "a", "y"), ("q2", "b", "y"), ("q3", "c", "x")], rows, kind, competes, Draws(1, "g"))
    assert out == [("q1", "a", "x"), ("q2", "b", "y"), ("q3", "c", "x")] and stats == {"already": 1, "swapped": 1, "no_option": 1}
    kept, stats = pair_competitors([("q1", "a", "y"), ("q3", "c", "x")], rows, kind, competes, Draws(1, "g"))
    assert kept[0] == ("q1", "a", "y") and stats["no_option"] == 2  # y would lose its last place


def test_rebalancing_meets_quotas_or_fails():
    import pytest

    from graphloom.operators.samplers import rebalance

    kind = {"n1": "node", "n2": "node", "r1": "relation"}
    rows = [("q1", "n1", 1), ("q1", "r1", 1), ("q2", "n1", 1), ("q3", "n2", 1)]
    selected = {("q1", 1): "n1", ("q2", 1): "n1", ("q3", 1): "n2"}
    out = rebalance(selected, rows, kind, {(1, "node"): 2, (1, "relation"): 1})
    assert out == {("q1", 1): "r1", ("q2", 1): "n1", ("q3", 1): "n2"}
    with pytest.raises(ValueError, match="can't be met"):
        rebalance(selected, rows, kind, {(1, "node"): 0, (1, "relation"): 3})


def test_queries_without_sql_cover_the_whole_table(spark):
    from pyspark.sql import functions as F

    from graphloom.plans import more
    from graphloom.plans.roles import role

    d = "/root/testdata/sf0.001"
    examples = role(spark, d, "examples")
    drawn = [r.k for r in role(spark, d, "relations").selectExpr("source % 5 AS k").distinct().collect()]
    assert more.provenance_queries(spark, d).count() == examples.count()
    assert more.normalized_schemas(spark, d).count() == examples.where((F.col("example_id") % 5).isin(drawn)).count()
    assert more.distractor_sampler(spark, d).count() == role(spark, d, "selection").select("example_id").distinct().count()
    assert "example_id <" not in more.contrast_sampler(spark, d)._jdf.queryExecution().logical().toString()
