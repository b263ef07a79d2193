import json

import pytest

from graphloom.functions import canonical, cypher, results
from graphloom.sources import files, sinks
from graphloom.streaming import ingest

LABELS = ["Ship", "Quay", "Crew"]
RELATIONS = [("Ship", "MOORS", "Quay"), ("Crew", "SERVES", "Ship")]
MOORS, SERVES = "relation:Ship|MOORS|Quay", "relation:Crew|SERVES|Ship"


@pytest.mark.parametrize(
    "query, relations, nodes",
    [
        ("MATCH (q:Quay)<-[m:MOORS {fee: 3}]-(s:Ship) RETURN s.flag", {MOORS}, {"Ship", "Quay"}),
        ("MATCH (c:Crew)-[:SERVES]->(s)-[:MOORS]->(q) RETURN count(*)", {MOORS, SERVES}, {"Ship", "Quay", "Crew"}),
        ("OPTIONAL MATCH (:Ship)-->(:Quay) RETURN 1", {MOORS}, {"Ship", "Quay"}),
        ("MATCH (:Quay)<--(:Ship)<--(x:Crew) RETURN x", {MOORS, SERVES}, {"Ship", "Quay", "Crew"}),
        ("MATCH (:Ship)--(:Crew) RETURN 1", {SERVES}, {"Ship", "Crew"}),
        ("MATCH (x) WHERE x:Crew AND x.age > 30 RETURN x", set(), {"Crew"}),
        ("MATCH (who)-[:SERVES]->(:Ship) RETURN who", {SERVES}, {"Ship", "Crew"}),
        ("MATCH (s:Ship) RETURN coalesce(s.flag, toUpper(trim(' none ')))", set(), {"Ship"}),
        ("MATCH (s:Ship {flag: 'a (sic)-[:MOORS]-> b'}) RETURN s", set(), {"Ship"}),
        ("MATCH (q:Quay) WHERE q.`mate's berth` <> '' MATCH (c:Crew)-[:SERVES]->(s:Ship) RETURN c", {SERVES}, {"Ship", "Quay", "Crew"}),
        ("MATCH (c:Crew) /* don't (z:Ship) */ RETURN c // (y:Quay)", set(), {"Crew"}),
        ("MATCH (anything) RETURN anything", set(), {"Ship", "Quay", "Crew"}),
        ("MATCH (a)-[:MOORS|SERVES*2]->(b) RETURN a", {MOORS, SERVES}, {"Ship", "Quay", "Crew"}),
    ],
)
def test_extraction(query, relations, nodes):
    x = cypher.extract(query, LABELS, RELATIONS)
    assert x.complete and x.relation_ids == relations and x.node_ids == {f"node:{n}" for n in nodes}


def test_what_cannot_be_mapped():
    x = cypher.extract("MATCH (:Quay)-->(:Ship) RETURN 1", LABELS, RELATIONS)
    assert not x.complete and x.unmatched == {"(:Quay)-[:?]->(:Ship)"} and not x.relation_ids
    x = cypher.extract("MATCH (:Crew)-[:OWNS]->(:Ship) RETURN 1", LABELS, RELATIONS)
    assert x.unmapped_types == {"OWNS"} and x.unmatched == {"(:Crew)-[:OWNS]->(:Ship)"}
    assert cypher.extract("MATCH (b:Buoy) RETURN b", LABELS, RELATIONS).unmapped_labels == {"Buoy"}
    x = cypher.extract("MATCH ()-[:MOORS]-() RETURN 1", [*LABELS, "Barge"], [*RELATIONS, ("Barge", "MOORS", "Quay")])
    assert x.complete and x.ambiguous_relations == 1 and len(x.relation_ids) == 2


def test_answers():
    assert cypher.answer_text('x {"cypher": "MATCH (n) RETURN \\"a\\""} y') == 'MATCH (n) RETURN "a"'
    assert cypher.answer_text("```cypher\nMATCH (n)\n```") == "MATCH (n)"
    assert cypher.answer_text('{"cypher": "MATCH (n) WHERE n.x = \\"a') == 'MATCH (n) WHERE n.x = "a'
    assert cypher.answer_text("  MATCH (n) ") == "MATCH (n)"
    assert cypher.answer_tokens("MATCH (n) WHERE n.a <> 'x y' ;") == cypher.answer_tokens("MATCH(n)\nWHERE n.a<>'x y'")


@pytest.mark.parametrize(
    "a, b, ordered, same",
    [
        ([], [], False, True), ([[1]], [], False, False), ([[1, "a"], [2, "b"]], [["b", 2], ["a", 1]], False, True),
        ([[1, "a"], [2, "b"]], [["b", 2], ["a", 1]], True, False), ([[1, "a"], [2, "b"]], [["a", 1], ["b", 2]], True, True),
        ([[1], [1], [2]], [[1], [2], [2]], False, False), ([[[1, 2]]], [[[2, 1]]], False, True), ([[1, True]], [[1.0, 1]], False, True),
        ([list(range(10)), list(range(1, 11))], [list(range(10))[::-1], list(range(1, 11))[::-1]], False, True),
        ([[1, 2], [2, 1]], [[1, 1], [2, 2]], False, False),
    ],
)
def test_result_equality(a, b, ordered, same):
    assert results.equal(a, b, ordered) is same


def test_canonical_json():
    assert canonical.py_json({"b": [1, "é"], "a": None}) == '{"a": null, "b": [1, "é"]}'
    assert canonical.schema_id("s", "g", {"b": 1, "a": 2}) == canonical.schema_id("s", "g", {"a": 2, "b": 1})


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", None), (2, "a", "x")], "id int, z string, a string")
    out = f"file://{tmp_path}/rows.jsonl"
    sinks.write_jsonl(df.coalesce(1), out)
    lines = sorted(x for f in (tmp_path / "rows.jsonl").glob("part-*") for x in f.read_text().splitlines())
    assert lines == ['{"a":"x","id":2,"z":"a"}', '{"id":1,"z":"b"}']
    with pytest.raises(Exception, match="already exists"):
        sinks.write_jsonl(df, out)
    assert files.read_records(spark, out, "id int, z string").count() == 2
    (tmp_path / "array.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.read_records(spark, f"file://{tmp_path}/array.json", "id int").count() == 2
    assert [r.id for r in files.read_ordered(spark, out, "id int").orderBy("pos").collect()] == [1, 2]
    with pytest.raises(Exception, match="missing or repeated"):
        files.unique_index(df.union(df), "id").collect()
    assert files.unique_index(df, "id").count() == 2
    sinks.write_json(spark, {"n": 1}, f"file://{tmp_path}/m.json")
    sinks.write_json(spark, {"n": 2}, f"file://{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 2}
    one, two = (files.fingerprint(spark, [f"file://{tmp_path}/array.json"], s) for s in ("a", "b"))
    assert one != two and one == files.fingerprint(spark, [f"file://{tmp_path}/array.json"], "a")
    assert sinks.manifest(df.groupBy("z").count(), ["z"]) == {"a": {"count": 1}, "b": {"count": 1}}
    assert [r.id for r in sinks.skip_done(df, df.where("id = 1"), "id").collect()] == [2]
    (tmp_path / "s" / "g1").mkdir(parents=True)
    (tmp_path / "s" / "g1" / "scores.jsonl").write_text('{"id": 1}\n')
    assert files.read_scores(spark, f"file://{tmp_path}/s/*/scores.jsonl", "id int").first().graph == "g1"


def test_streams_take_each_file_once(spark, tmp_path):
    kind = "example_id long, question string, cypher string, n_units long, complete boolean"
    (tmp_path / "in").mkdir()
    write = lambda n, **x: (tmp_path / "in" / f"{n}.jsonl").write_text(json.dumps({"example_id": n, "question": "q", "cypher": "c", "n_units": 3, "complete": True} | x) + "\n")
    write(1)
    write(2, question="")
    source, out, seen = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/seen"
    for n in (3, 4):
        ingest.route_stream(ingest.read_examples(spark, source, kind), out, seen).awaitTermination()
        ingest.append_once(ingest.read_examples(spark, source, kind, 1), lambda b: b.select("example_id"), out + "2", seen + "2").awaitTermination()
        write(n, n_units=0)
    got = spark.read.parquet(out).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {None: 1, "missing_question_or_cypher": 1, "empty_normalized_schema": 1}
    assert sorted(r.example_id for r in spark.read.parquet(out + "2").collect()) == [1, 2, 3]
