"""The corpus build: a table against plain loops, and streams against the table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import versions
from graphloom.streaming import corpus

EXAMPLE = "example_id string, split string, graph string, schema_id string, question string, cypher string, units array<string>, complete boolean, issues array<string>, arrived timestamp"
SCHEMAS = [("s1", ["node:A", "node:B", "relation:A|r|B"]), ("s2", ["node:C", "node:D", "node:E", "relation:C|x|D", "relation:D|y|E"]), ("s3", []), ("s1", ["node:A", "node:B", "relation:A|r|B"])]


def examples(seed, n):
    r, known = random.Random(seed), dict(SCHEMAS)
    out = []
    for i in range(n):
        s = r.choice(["s1", "s2", "s2", "s3", "none", None])
        units = r.sample(known.get(s, []), r.randint(0, len(known.get(s, []))))
        out.append({
            "example_id": f"e{i}", "split": r.choice(["train", "dev", "test"]), "graph": "g", "schema_id": s, "question": r.choice(["what", "what", "who", "", None]), "cypher": r.choice(["MATCH", "RETURN", "RETURN", ""]),
            "units": r.choice([units, units, units, None, units + ["node:Gone"]]), "complete": r.choice([True, True, True, False, None]), "issues": r.choice([None, [], ["odd type", "no name"]]), "arrived": f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}",
        })
    return out


def truth(rows, strict):
    """Outputs but for the sample of negatives."""
    known, out = dict(SCHEMAS), {k: [] for k in corpus.OUTPUTS}
    for e in rows:
        ids = known.get(e["schema_id"], [])
        gold = [u for u in ids if u in (e["units"] or [])]
        whole = bool(e["complete"]) and len(gold) == len(set(e["units"] or []))
        text = bool(e["question"]) and bool(e["cypher"])
        head = (e["example_id"], e["source"], e["split"], "g", e["schema_id"])
        nodes, relations = ([u for u in gold if u.startswith(k)] for k in ("node:", "relation:"))
        kind = lambda u: u.split(":")[0]
        reason = "missing_question_or_cypher" if not text else "empty_normalized_schema" if not ids else "no_schema_units_resolved" if not gold else "incomplete_gold_subschema" if strict and not whole else None
        if reason:
            out["rejected"].append((*head, e["question"], e["cypher"], reason))
        else:
            out["generation"].append((*head, e["question"], e["cypher"], nodes, relations))
            out["selection"] += [(*head, e["question"], u, kind(u), int(u in gold)) for u in ids]
        out["issues"] += [(*head, x) for x in e["issues"] or []]
        if e["split"] == "test" and text and ids:
            ok = bool(gold) and whole
            out["inference_generation"].append((*head, e["question"], e["cypher"], ok, nodes if ok else None, relations if ok else None))
            out["inference_selection"] += [(*head, e["question"], u, kind(u), int(u in gold) if ok else None) for u in ids]
    return {k: sorted(v, key=repr) for k, v in out.items()}


def rows(made):
    return {k: sorted((tuple(r) for r in df.collect()), key=repr) for k, df in made.items()}


def table(spark, part):
    return spark.createDataFrame([tuple(e[c.split()[0]] for c in EXAMPLE.split(", ")) for e in part], EXAMPLE.replace("arrived timestamp", "arrived string")).withColumn("arrived", F.to_timestamp("arrived"))


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame(SCHEMAS, "schema_id string, units array<string>")


@pytest.mark.parametrize("strict", [True, False])
def test_a_table_against_loops(spark, schemas, strict):
    a, b = examples(1, 90), examples(2, 40)
    got = corpus.build_table({"one": table(spark, a + a[:9]), "two": table(spark, b)}, schemas, strict)
    want = truth([e | {"source": "one"} for e in a] + [e | {"source": "two"} for e in b], strict)
    assert rows(got) == want and all(want.values())
    n = {(r.source, r.split, r.output): (r.n, r.labelled) for r in corpus.counts(got).collect()}
    assert n["one", "test", "inference_selection"][0] == sum(x[1:3] == ("one", "test") for x in want["inference_selection"])
    assert n["two", "train", "selection"][1] == sum(x[1:3] == ("two", "train") and x[-1] == 1 for x in want["selection"])


def test_negatives_are_sampled_inside_a_row(spark, schemas):
    a = examples(3, 120)
    for ratio in (0.0, 0.5, 1.0, 9.0):
        got = corpus.build_table({"one": table(spark, a).repartition(7)}, schemas, negative_ratio=ratio)["selection"]
        per = {}
        for r in got.collect():
            per.setdefault(r.example_id, []).append(r.label)
        full = truth([e | {"source": "one"} for e in a], True)["selection"]
        for e, labels in per.items():
            pos, neg = (sum(x[0] == e and x[-1] == v for x in full) for v in (1, 0))
            assert sum(labels) == pos and len(labels) - pos == min(neg, round(pos * ratio))


def test_streams_give_the_rows_of_tables_after_a_crash_between_outputs(spark, schemas, tmp_path):
    a, b = examples(4, 60), examples(5, 30)
    path = f"file://{tmp_path}/out"

    def put(name, source, part):
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / f"{name}.json").write_text("\n".join(map(json.dumps, part)))

    def run():
        read = lambda s: spark.readStream.schema(EXAMPLE).option("maxFilesPerTrigger", 1).json(str(tmp_path / s))
        corpus.build_stream({"one": read("a"), "two": read("b")}, schemas, path, str(tmp_path / "check"), "1 hour", negative_ratio=1.0).awaitTermination(180)

    put("1", "a", a[:25])
    put("1", "b", b)
    run()
    put("2", "a", a[20:40])
    real, seen = versions.append, []

    def third_fails(df, to, batch):
        seen.append(to)
        if len(seen) == 3:
            raise RuntimeError("breaks off")
        return real(df, to, batch)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(versions, "append", third_fails)
        with pytest.raises(Exception, match="breaks off"):
            run()
    put("3", "a", a[40:])
    run()
    want = rows(corpus.build_table({"one": table(spark, a), "two": table(spark, b)}, schemas, negative_ratio=1.0))
    assert rows(corpus.read_outputs(spark, path)) == want
