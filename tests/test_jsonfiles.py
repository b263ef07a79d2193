"""JSON files in small splits against the whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import jsonfiles


@pytest.fixture(params=[60, 1 << 20])
def splits(spark, request):
    for k, v in (("spark.sql.files.maxPartitionBytes", request.param), ("spark.sql.files.openCostInBytes", 10)):
        spark.conf.set(k, v)
    yield request.param
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def objects(seed, n):
    r = random.Random(seed)
    texts = ['plain', '}', '{"', '\\', '"', 'a\\"}b', '},\n{', 'ü🙂}', '', '[]', "\\\\", "\n"]
    return [{"id": i, "text": "".join(r.choice(texts) for _ in range(r.randint(0, 6))), "inner": {"a": r.choice(texts), "list": [{"x": r.choice(texts)} for _ in range(r.randint(0, 3))]}} for i in range(n)]


KIND = "id long, text string, inner struct<a:string,list:array<struct<x:string>>>"


def shaped(r):
    return {"id": r.id, "text": r.text, "inner": {"a": r.inner.a, "list": [{"x": y.x} for y in r.inner.list]}}


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_split_among_tasks(spark, tmp_path, splits, indent):
    files = {"a.json": objects(1, 40), "b.json": objects(2, 1), "c.json": []}
    for name, rows in files.items():
        (tmp_path / name).write_text(json.dumps(rows, indent=indent, ensure_ascii=name == "b.json") + "\n")
    df = jsonfiles.read_array(spark, f"file://{tmp_path}", KIND)
    got = df.collect()
    for name, rows in files.items():
        assert [shaped(r) for r in sorted((r for r in got if r.file.endswith(name)), key=lambda r: r.pos)] == rows
    assert [r.pos for r in sorted((r for r in got if r.file.endswith("a.json")), key=lambda r: r.pos)] == list(range(40))
    if splits == 60:
        assert jsonfiles._split_text(spark, f"file://{tmp_path}", "}").rdd.getNumPartitions() > 10


@pytest.mark.parametrize("text", ['[1, {"id": 1}]', '{"id": 1}', '[{"id": 1} {"id": 2}]', '[{"id": 1}', '[{"id": 1}, {"id": 2', '[{"id": 1}] x', '[{"id": "word"}]', '[{"id": 1}, 7]', "word", '[{"id": 1}}]'])
@pytest.mark.parametrize("splits", [60], indirect=True)
def test_other_files_fail(spark, tmp_path, splits, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match=r"bad.json\[\d+\]: not a"):
        jsonfiles.read_array(spark, f"file://{tmp_path}/bad.json", "id long").collect()


def test_lines_have_their_numbers(spark, tmp_path, splits):
    rows = objects(3, 60)
    text = "".join(json.dumps(x) + "\n" + "\n" * (x["id"] % 3 == 0) for x in rows)
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("\n\n" + json.dumps(rows[0]))
    got = jsonfiles.read_lines(spark, f"file://{tmp_path}", KIND).collect()
    where = {json.loads(line)["id"]: i for i, line in enumerate(text.split("\n"), 1) if line}
    assert {r.id: r.line for r in got if r.file.endswith("a.jsonl")} == where
    assert [r.line for r in got if r.file.endswith("b.jsonl")] == [3] and all(shaped(r) == rows[r.id] for r in got)
    for n in (1, 7, 61, 500):
        first = jsonfiles.read_lines(spark, f"file://{tmp_path}", KIND, n).collect()
        assert [r.id for r in sorted(first, key=lambda r: (r.file, r.line))] == [*range(60), 0][:n]


@pytest.mark.parametrize("bad", ["[1]", "7", '{"id": ', '{"id": 1} x', '{"id": "word"}', "null"])
@pytest.mark.parametrize("splits", [60], indirect=True)
def test_a_bad_line_is_named(spark, tmp_path, splits, bad):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n' + bad + '\n{"id": 2}\n')
    with pytest.raises(Exception, match=r"a.jsonl:3: not a JSON object"):
        jsonfiles.read_lines(spark, f"file://{tmp_path}/a.jsonl", "id long").collect()


@pytest.mark.parametrize("splits", [60], indirect=True)
def test_a_limit_stops_every_task(spark, tmp_path, splits):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"id": {i}}}\n' for i in range(400)))
    read = jsonfiles._head(spark, f"file://{tmp_path}/a.jsonl", 3)
    blocks = read.select("file", "block").distinct().count()
    assert read.count() <= 3 * blocks and [r.id for r in jsonfiles.read_lines(spark, f"file://{tmp_path}/a.jsonl", "id long", 3).orderBy("line").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        jsonfiles.read_lines(spark, f"file://{tmp_path}/a.jsonl", "id long", 0)
    assert read.where(F.col("value") == "").count() == 0
