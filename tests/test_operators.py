"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scores, text
from graphloom.operators import metrics, profile, routing, sampling, units, windows


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def words(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_threshold_sweep(spark):
    rows = spark.createDataFrame([("q1", "a", 1, 0.9), ("q1", "b", 0, 0.6), ("q2", "c", 1, 0.45), ("q2", "d", 0, 0.1)], "example_id string, unit string, label int, p_yes double")
    got = {r.threshold: r for r in metrics.threshold_sweep(rows, [0.4, 0.5, 0.7]).collect()}
    assert (got[0.5].precision, got[0.5].recall, got[0.5].extra_per_question, got[0.5].missing_pct, got[0.5].exact_pct) == (50, 50, 0.5, 50, 0)
    assert math.isclose(got[0.4].precision, 200 / 3) and (got[0.4].recall, got[0.4].exact_pct) == (100, 50)
    assert (got[0.7].precision, got[0.7].recall, got[0.7].extra_per_question) == (100, 50, 0)


def test_invalid_is_never_a_true_negative(spark):
    rows = spark.createDataFrame([(1, "INVALID"), (0, "INVALID"), (1, "YES"), (0, "NO")], "label int, predicted string")
    r = metrics.confusion(rows, []).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.invalid, r.accuracy) == (1, 0, 1, 1, 2, 0.5)


def test_errors_score_zero_and_missing_do_not_count(spark):
    rows = spark.createDataFrame([("g", 1, False), ("g", None, True), ("g", 1, False), ("h", None, False)], "graph string, metric int, failed boolean")
    got = {r.graph: r for r in metrics.rollup_scores(rows).collect()}
    assert math.isclose(got["g"].mean, 2 / 3) and got["h"].mean is None and got["overall"].n_scored == 3


def test_largest_remainder_sums_to_the_total(spark):
    rows = spark.createDataFrame([("a", k, w) for k, w in enumerate([3, 3, 3, 1])], "g string, k int, w int")
    got = {r.k: r.quota for r in sampling.largest_remainder(rows, "g", "k", "w", 7).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 1} and sum(got.values()) == 7


@pytest.mark.parametrize("s, g, b", [(10, 4, 4), (4, 10, 4), (3, 3, 4), (5, 9, 4), (0, 3, 4), (7, 0, 4), (6, 6, 2)])
def test_interleaving_uses_every_row_once(spark, s, g, b):
    make = lambda n, p: spark.createDataFrame([(f"{p}{i}", i) for i in range(n)], "id string, i long")
    got = sorted((r.position, r.task, r.id) for r in sampling.interleave_all(make(s, "s"), make(g, "g"), "id", b, s, g).collect())
    assert [p for p, _, _ in got] == list(range(s + g))
    for task, prefix in ((1, "s"), (0, "g")):
        mine = [x for _, t, x in got if t == task]
        assert mine == sorted(mine, key=lambda x: int(x[1:])) and all(x[0] == prefix for x in mine)


def test_numbering_is_global(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.i for r in sampling.number(rows, ["k"]).collect())


def test_closure_adds_the_ends_of_relations(spark):
    chosen = spark.createDataFrame([(1, "relation", "r1"), (1, "node", "a")], "k int, kind string, unit string")
    relations = spark.createDataFrame([("r1", "a", "b")], "unit string, source string, target string")
    got = sorted((r.kind, r.unit, r.closure) for r in units.close_selection(chosen, relations, "k").collect())
    assert got == [("node", "a", False), ("node", "b", True), ("relation", "r1", False)]


def test_patterns_match_by_direction_and_type(spark):
    relations = spark.createDataFrame([("Person", "ACTED_IN", "Movie"), ("Person", "LIVES_IN", "City")], "source string, type string, target string")
    patterns = spark.createDataFrame(
        [(1, "ACTED_IN", ["Person"], ["Movie"], "out"), (2, "ACTED_IN", ["Person"], ["Movie"], "in"), (3, None, ["Movie"], [], "undirected"), (4, None, [], [], "out")],
        "pattern int, type string, lefts array<string>, rights array<string>, direction string",
    )
    got = sorted((r.pattern, r.rel_type) for r in units.match_relations(patterns, relations).collect())
    assert got == [(1, "ACTED_IN"), (3, "ACTED_IN"), (4, "ACTED_IN"), (4, "LIVES_IN")]


def test_turn_order(spark):
    talk = lambda c, *roles: [(c, i, r) for i, r in enumerate(roles)]
    rows = talk(1, "system", "user", "assistant") + talk(2, "user", "user", "assistant") + talk(3, "user", "system") + talk(4, "assistant", "user") + talk(5, "user")
    got = {r.conv_id: r.well_formed for r in windows.turn_problems(spark.createDataFrame(rows, "conv_id int, turn int, role string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_runs_and_islands(spark):
    rows = spark.createDataFrame([(1, p, v) for p, v in [(1, "a"), (2, "a"), (4, None), (5, None), (6, "a")]], "k int, p int, v string")
    assert sorted((r.run, r.v, r.n) for r in windows.runs(rows, ["k"], "p", "v").collect()) == [(1, "a", 2), (2, None, 2), (3, "a", 1)]
    assert sorted((r.start, r.end) for r in windows.islands(rows, "k", "p").collect()) == [(1, 2), (4, 6)]


def test_medians(spark):
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4, 10, 10)], "g string, v int")
    assert profile.upper_median(rows, ["g"], "v").first().p50 == 4
    assert math.isclose(profile.length_profile(rows.where("v < 10").union(rows.limit(0)), ["g"], "v", 3).first().p90, 3.7)


def test_overlap_scores(spark):
    r = one(
        spark, r1=scores.rouge_n(words("a", "a", "b"), words("a", "b", "c"), 1), l=scores.lcs_length(words("a", "b", "c", "d"), words("b", "x", "c", "d")),
        both=scores.rouge_n(words(), words(), 1), none=scores.rouge_l(words("a"), words("b")), j=scores.jaccard(words("1", "2"), words("2", "3")), e=scores.jaccard(words(), words()),
    )
    assert math.isclose(r.r1, 2 / 3) and r.l == 3 and r.both == 1.0 and r.none == 0.0 and math.isclose(r.j, 1 / 3) and r.e == 0.0


def test_kernels_vanish_at_identity(spark):
    p = scores.softmax(F.array(*[F.lit(x) for x in (1.0, 2.0, 0.5)]))
    r = one(spark, rkl=scores.reverse_kl(p, p), srkl=scores.skewed_reverse_kl(p, p), bdl=scores.blended_kl(p, p), c=scores.cosine(p, p), m=scores.masked_mean(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(-100), F.lit(1))))
    assert all(abs(x) < 1e-12 for x in (r.rkl, r.srkl, r.bdl)) and math.isclose(r.c, 1) and r.m == 3.0


def test_text_functions(spark):
    r = one(
        spark, a=text.clean_identifier(F.lit(" :`Movie Star` ")), b=text.property_type(F.lit("list<int>")), c=text.property_type(F.lit("date-time")), d=text.property_type(F.lit(None).cast("string")),
        e=text.without_end_of_turn(F.lit("MATCH (n) <end_of_turn>")), f=text.without_end_of_turn(F.lit(" x ")), g=text.identifier_words(F.lit("actedInMovies ABCParts of_glass all_99 IDs2024")), j=text.question_words(F.lit("Which MOVIES won 200 prizes, and a bus for class-9?")),
        h=text.node_text(F.lit("P"), F.create_map(F.lit("b"), F.lit("INT"), F.lit("a"), F.lit("STRING"))), i=text.duration(F.lit(3725.9)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("Movie Star", "LIST", "DATE_TIME", "UNKNOWN", "MATCH (n)", " x ")
    assert (r.h, r.i) == ("(:P { a: STRING, b: INT })", "01:02:05")
    assert (r.g, r.j) == (["acted", "movie", "abc", "part", "glas", "2024"], ["movie", "won", "200", "prize", "bus", "clas"])


def test_labels_and_requirements_fail_loudly(spark):
    with pytest.raises(Exception, match="not a label"):
        spark.range(1).select(routing.label_text(F.lit(2))).collect()
    with pytest.raises(Exception, match="ids repeat"):
        routing.require(spark.range(2), F.col("id") < 1, "ids repeat").collect()
    p = F.when(F.col("id") == 0, F.lit(0.3))
    got = [r.x for r in spark.range(2).select(routing.decide(F.lit(True), F.lit("NO"), p, 0.2).alias("x")).collect()]
    assert got == ["YES", "NO"]


def test_templates_fill_at_once(spark):
    assert one(spark, t=text.fill("Q: {q} {{x}} S: {s}", {"q": F.lit("{s}"), "s": F.lit("a")})).t == "Q: {s} {x} S: a"
