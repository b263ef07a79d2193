"""Adapters, prompts, kernels, run plans, sinks and numbering."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import prompts, schemas, scores
from graphloom.operators import control, sampling, units
from graphloom.sources import corpora, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_numbers_of_many_rows(spark):
    n = 2_000_000
    rows = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("k"), F.lit("x").alias("extra"))
    got = sampling.number(rows, ["k"])
    assert got.columns == ["k", "extra", "i"]
    r = got.agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_if(F.col("i") != F.col("k")).alias("off")).first()
    assert (r.n, r.d, r.lo, r.hi, r.off) == (n, n, 0, n - 1, 0)


def test_numbers_with_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 1), ("b", None)], "k string, v int")
    assert sorted((r.i, r.k, r.v) for r in sampling.number(rows, ["k", "v"]).collect()) == [(0, None, 1), (1, "a", 1), (2, "a", 2), (3, "b", None)]
    assert sampling.number(rows.where("false"), ["k"]).count() == 0


def test_results_of_other_rows_are_refused(spark):
    rows = spark.range(100).select("id", (F.col("id") * 3).alias("pos"))
    assert sorted(r.id for r in sampling.after_progress(rows, ["pos"], "id", rows.where("id < 40")).collect()) == list(range(40, 100))
    with pytest.raises(Exception, match="not those of the first rows"):
        sampling.after_progress(rows, ["pos"], "id", rows.where("id < 40 and id <> 3")).collect()


def test_blocks_keep_pairs_together_and_even_out_ranks(spark):
    rows = spark.range(100).select(F.col("id").alias("pos"))
    got = sampling.shuffled_blocks(rows, "pos", 6, 3, replicas=4, epoch=2, first=3, count=7).collect()
    batches = {}
    for r in got:
        batches.setdefault(r.position, []).append(r)
    assert sorted(batches) == list(range(16)) and all(len(b) == 6 and len({r.batch for r in b}) == 1 for b in batches.values())
    assert {p % 4 for p in batches} == {r.rank for r in got} and all(b[0].rank == p % 4 for p, b in batches.items())
    alone = sampling.shuffled_blocks(rows, "pos", 6, 3).collect()
    assert len(alone) == 100 and max(r.position for r in alone) == 16
    order = {r.position: r.batch for r in alone}
    assert all(order[p + 1] == order[p] + 1 for p in range(0, 16, 2)) and sampling.dropped_batches(16, 4, 1, 0, 0) == set()
    with pytest.raises(ValueError, match="too few"):
        sampling.dropped_batches(18, 4, 0, 3, 1)
    assert sampling.dropped_batches(18, 4, 1, 3, 5) == {5, 6}
    layout = spark.range(43).select("id", F.col("id").isin(3, 9, 41).alias("pair"))
    assert sorted(r.batch for r in sampling.droppable(layout, "id", "pair", 4).collect()) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_overlap_scores_of_long_texts(spark):
    a, b = [f"w{i % 700}" for i in range(3000)], [f"w{i % 900}" for i in range(2500)]
    table = [[0] * (len(b[:60]) + 1) for _ in range(61)]
    for i, x in enumerate(a[:60]):
        for j, y in enumerate(b[:60]):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert scores.lcs(a[:60], b[:60]) == table[60][60] and scores.lcs([], a) == 0 and scores.lcs(list("abcbdab"), list("bdcaba")) == 4
    rows = spark.createDataFrame([(1, a, b), (2, [], []), (3, ["x"], [])], "id int, a array<string>, b array<string>")
    by_rows = {r.id: r.score for r in scores.ngram_scores(rows, "id", "a", "b", 2).collect()}
    by_column = {r.id: r.s for r in rows.select("id", scores.rouge_n(F.col("a"), F.col("b"), 2).alias("s")).collect()}
    assert by_rows.keys() == by_column.keys() and all(math.isclose(by_rows[k], by_column[k]) for k in by_rows)


def test_kernels(spark):
    x, y = (F.array(*[F.lit(v) for v in vs]) for vs in ((1.0, 2.0, 0.5), (0.0, 1.5, 3.0)))
    p, q = scores.logs(x), scores.logs(y)
    r = one(
        spark, same=scores.contrastive_sd(x, x), ts=scores.contrastive_sd(x, y, "TS"), far=scores.logs(F.array(F.lit(0.0), F.lit(-2000.0))), none=scores.soft_labels(x, x), step=scores.step_loss(x, y, x, y),
        at_q=scores.assistant_divergence(p, q, "fkl", "qr", lam=0.0), at_p=scores.assistant_divergence(p, q, "ab", "pr", lam=1.0), up=scores.assistant_divergence(p, q, "fkl", "rp", alpha=2.0),
        h=scores.hybrid_policy(p, q, F.lit(0), F.lit(0)), d=scores.drawn_token(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), F.lit(0.69)), clean=scores.clean_logits(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(2.0))),
    )
    assert abs(r.same) < 1e-12 and math.isfinite(r.ts) and r.far[1] == -2000.0 and abs(r.none) < 1e-12 and abs(r.step) < 1e-12
    assert abs(r.at_q) < 1e-12 and abs(r.at_p) < 1e-12 and r.up > 0 and r.d == 1 and list(r.clean) == [0.0, 0.0, 2.0]
    lp, lq = (math.log(math.exp(v[0]) / sum(map(math.exp, v))) for v in ((1.0, 2.0, 0.5), (0.0, 1.5, 3.0)))
    k = (lp - lq) * math.exp(lq)
    assert k > 0 and math.isclose(r.h, -lq * (k + math.exp(lp)))
    with pytest.raises(ValueError, match="unknown divergence"):
        scores.assistant_divergence(p, q, "kl")
    assert set(scores.KERNELS) == {"fkl", "rkl", "sfkl", "srkl", "bdl", "csd", "amid", "hpd"}


def test_misses_never_empty_a_question(spark):
    rows = [(1, "r1", "relation", 1, "a", "b"), (1, "r2", "relation", 0, "b", "c"), (1, "a", "node", 1, None, None), (1, "b", "node", 1, None, None), (1, "c", "node", 0, None, None),
            (2, "r1", "relation", 1, "a", "b"), (2, "a", "node", 1, None, None), (3, "a", "node", 1, None, None), (3, "b", "node", 1, None, None), (4, "a", "node", 0, None, None), (4, "b", "node", 0, None, None)]
    got = {}
    for r in units.missed(spark.createDataFrame(rows, "k int, unit string, kind string, label int, source string, target string"), "k", 1.1, 1).collect():
        got.setdefault(r.k, set()).add(r.unit)
    assert got[1] == {"r1", "a"} and 2 not in got and 4 not in got and len(got[3]) == 1


def test_arguments_and_reports():
    assert control.parse_thresholds("0.2:0.4:0.1") == [0.2, 0.3, 0.4] and control.parse_thresholds("0.5, 0.9") == [0.5, 0.9]
    for bad in (lambda: control.parse_thresholds("3:1:1"), lambda: control.hub_path("x/y"), lambda: control.stop_ids([], None)):
        with pytest.raises(ValueError):
            bad()
    assert control.hub_path("hf://o/n/f/g.json") == ("o/n", "f/g.json")
    assert control.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": None}) == {"a": {"x": 1, "y": 3}, "b": None}
    assert control.stop_ids([3, 1], None, 3) == [3, 1]
    row = {"threshold": 0.5, "precision": 50.0, "recall": 100.0, "f1": 66.6, "extra_per_question": 0.25, "missing_pct": 0.0, "exact_pct": 12.5}
    lines = control.report([row, row | {"threshold": "greedy"}]).splitlines()
    assert lines[1].split() == ["0.50", "50.0", "100.0", "66.6", "0.25", "0.0", "12.5"] and lines[2].startswith("   greedy") and len({*map(len, lines)}) == 1


def test_corpora_in_three_layouts(spark, tmp_path):
    root = tmp_path / "b"

    def put(path, value, lines=False):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("\n".join(map(json.dumps, value)) + "\n" if lines else json.dumps(value))

    sea = {"name": "sea", "entities": [{"label": "Ship"}], "relations": []}
    put("Cypherbench/test.jsonl", [{"qid": "q1", "graph": "sea", "nl_question": " which? ", "gold_cypher": "MATCH (s) "}, {"user_prompt": f"QUESTION:\nwho?\n\nSCHEMA:\n{json.dumps(sea)}\n\nGenerate a Cypher query now", "response": json.dumps({"cypher": "RETURN 1"})}], True)
    put("Cypherbench/graphs/schemas/sea_schema.json", sea)
    put("Mind_the_query/train_val.json", [{"qid": 7, "graph": "port", "question": "how?", "nl_question": "no", "gold_cypher": "RETURN 2"}, {"graph": "", "nl_question": "then?"}])
    put("Mind_the_query/graphs/schemas/port.json", {"port": {"node_props": {"Quay": []}, "relationships": []}})
    put("Neo4j_Text2Cypher/dev.json", [{"instance_id": "i", "nl_question": "a?", "question": "b?", "gold_cypher": "RETURN 3", "schema": "(:A)-[:R]->(:B)"}])
    base = f"file://{root}"
    got = {s: corpora.examples(spark, base, s, p).orderBy("pos").collect() for s, p in (("cypherbench", "test"), ("mind_the_query", "train"), ("neo4j_text2cypher", "val"))}
    assert [(r.example_id, r.graph, r.question, r.cypher) for r in got["cypherbench"]] == [("cypherbench:test:sea:q1", "sea", "which?", "MATCH (s)"), ("cypherbench:test:sea:1", "sea", "who?", "RETURN 1")]
    assert [r.schema_reference for r in got["cypherbench"]] == ["Cypherbench/graphs/schemas/sea_schema.json", "test.jsonl[1].user_prompt.SCHEMA"]
    assert [json.loads(r.schema_text) for r in got["cypherbench"]] == [sea, sea]
    assert [(r.example_id, r.question, r.cypher, r.schema_text is None) for r in got["mind_the_query"]] == [("mind_the_query:train:port:7", "how?", "RETURN 2", False), ("mind_the_query:train:unknown:1", "then?", "", True)]
    (r,) = got["neo4j_text2cypher"]
    assert (r.example_id, r.question, r.schema_reference, r.kind) == ("neo4j_text2cypher:val:unknown:i", "a?", "dev.json[0].schema", "text")
    every = corpora.examples(spark, base, "cypherbench", "test").unionByName(corpora.examples(spark, base, "neo4j_text2cypher", "val"))
    assert [r.n_units for r in schemas.normalize_distinct(every, "kind", "graph", "schema_text").orderBy("example_id").collect()] == [1, 1, 3]
    with pytest.raises(FileNotFoundError):
        corpora.examples(spark, base, "cypherbench", "train")
    with pytest.raises(ValueError, match="unknown split"):
        corpora.examples(spark, base, "cypherbench", "later")
    with pytest.raises(Exception, match="not a prompt record"):
        spark.range(1).select(corpora.prompt_record(F.lit("Q"), F.lit("{}"))).collect()
    assert corpora.read_object(spark, f"{base}/Cypherbench/graphs/schemas/sea_schema.json").count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        corpora.read_object(spark, f"{base}/Neo4j_Text2Cypher/dev.json").collect()


def test_prompts(spark):
    p = prompts.Prompts("sys", "Q {question} U {schema_unit} C {schema_context}", "gen", "Q {question} S {candidate_schema} O {other_schema} {{x}}")
    assert len(p.fingerprints()) == 4 and len(set(p.fingerprints().values())) == 4
    r = one(spark, s=p.selector(F.lit("{schema_unit}"), F.lit("u"), F.lit("c")), g=p.generator(F.lit("q"), F.lit('{"a":[1]}'), F.lit("{}")))
    assert [(m.role, m.content) for m in r.s] == [("system", "sys"), ("user", "Q {schema_unit} U u C c")]
    assert r.g[1].content == 'Q q S {\n  "a": [\n    1\n  ]\n} O {} {x}'
    chat = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.lit("hi").alias("content")))
    r = one(spark, q=prompts.render_chat(chat("user"), "qwen"), n=prompts.render_chat(chat("user"), "qwen", reply=False))
    assert r.q == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and r.n == "<|im_start|>user\nhi<|im_end|>\n"
    with pytest.raises(Exception, match="not a message"):
        one(spark, x=prompts.render_chat(chat("tool"), "llama3"))


def test_outputs_are_guarded_and_copied(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    sinks.write_jsonl(spark.range(5), f"{out}/train.jsonl")
    with pytest.raises(FileExistsError):
        sinks.guard(spark, [], [f"{out}/train.jsonl"])
    with pytest.raises(ValueError, match="outputs are inputs"):
        sinks.guard(spark, [out], [f"{out}/"])
    assert sinks.free_path(spark, out, "t1") == f"{out}-t1" and sinks.free_path(spark, f"{out}9", "t1") == f"{out}9"
    sinks.copy(spark, f"{out}/train.jsonl", f"{out}/copy.jsonl")
    assert spark.read.json(f"{out}/copy.jsonl").count() == 5


def test_chained_contrast_pairs_stay_among_a_questions_units(spark):
    from graphloom.plans import building
    from graphloom.plans.roles import role

    d = "/root/testdata/sf0.001"
    got = building.contrast_chain(spark, d).collect()
    held = {(str(r.example_id), str(r.unit_id), r.label) for r in role(spark, d, "selection").collect()}
    assert len(got) == 200 and len({(r.graph, r.example_id) for r in got}) == 200
    assert all((r.example_id, r.positive, 1) in held and (r.example_id, r.negative, 0) in held for r in got)


def test_surplus_rows_of_either_side_are_noticed(spark):
    from graphloom.operators import selection

    left = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "z")], "i int, g string, k string")
    for n, want in ((3, {"a": True, "b": True}), (2, {"a": True, "b": False}), (5, {"a": True, "b": True, None: False})):
        right = spark.createDataFrame([(i, "xyzvw"[i]) for i in range(n)], "i int, o string")
        assert {r.g: r.agrees for r in selection.grouped_pairs(left, right, "g", "k", "o", []).collect()} == want


def test_null_schemas_and_repeated_schema_ids(spark):
    from graphloom.functions.schemas import normalize_distinct
    from graphloom.operators.extraction import extract_all

    rows = spark.createDataFrame([(1, "text", "g", None), (2, "text", "g", ""), (3, "text", None, None), (4, "text", "g", None)], "id int, kind string, graph string, text string")
    got = {r.id: (r.error, r.n_units) for r in normalize_distinct(rows, "kind", "graph", "text").collect()}
    assert len(got) == 4 and got[1] == got[4] and all(n == 0 and error for error, n in got.values())
    queries = spark.createDataFrame([(1, 7, "MATCH (a:A) RETURN a")], "id int, schema_id int, query string")
    kind = "schema_id int, labels array<string>, relations array<struct<source:string,type:string,target:string>>"
    for ship in (0, 1 << 20):
        with pytest.raises(ValueError, match="stands 2 times"):
            extract_all(queries, spark.createDataFrame([(7, ["A"], []), (7, ["B"], [])], kind), "id", ship_up_to=ship)
        assert extract_all(queries, spark.createDataFrame([(7, ["A"], [])], kind), "id", ship_up_to=ship).count() == 1
