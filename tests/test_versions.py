"""Append logs and published versions that crash between any two steps."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.sources import versions
from graphloom.streaming import ingest

STEPS = ("_write_table", "_document", "_delete")


class Crash(Exception):
    pass


def crash_at(monkeypatch, k):
    """The k-th step breaks off, before it where k is even, after it where it is odd. Returns the number of steps so far."""
    seen = [0]
    for name in STEPS:

        def wrapped(*args, real=getattr(versions, name), **kwargs):
            i, seen[0] = seen[0], seen[0] + 1
            if k == 2 * i:
                raise Crash
            real(*args, **kwargs)
            if k == 2 * i + 1:
                raise Crash

        monkeypatch.setattr(versions, name, wrapped)
    return seen


def batch(spark, i):
    return spark.range(i * 10, i * 10 + 10, 1, 2).select("id", F.concat(F.lit("text ü "), "id").alias("text"))


KIND = "id long, text string"


def test_each_row_once_after_a_crash_at_any_step(spark, tmp_path):
    for k in range(4):
        path = f"file://{tmp_path}/log{k}"
        with pytest.MonkeyPatch.context() as m:
            crash_at(m, k)
            with pytest.raises(Crash):
                for i in range(3):
                    versions.append(batch(spark, i), path, i)
        # A crash leaves what is committed and nothing else to see.
        n, rows, size = versions.progress(spark, path)
        assert versions.read_log(spark, path, KIND).count() == rows == 10 * n
        assert versions.recover(spark, path) == (n, rows, size)
        for i in range(3):
            assert versions.append(batch(spark, i), path, i) == (i >= n)
        got = versions.read_log(spark, path, KIND).orderBy("id").collect()
        assert [(r.id, r.text, r.batch) for r in got] == [(i, f"text ü {i}", i // 10) for i in range(30)]
        assert versions.progress(spark, path)[:2] == (3, 30)
        folders = [p for p in (tmp_path / f"log{k}").iterdir() if p.name.startswith("part-")]
        assert len(folders) == 3 and sum(f.stat().st_size for p in folders for f in p.glob("part*.json")) == versions.progress(spark, path)[2]


def test_files_are_cut_back_to_their_commits(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    versions.append(batch(spark, 0), path, 0)
    want = versions.progress(spark, path)
    file = next((tmp_path / "log").glob("part-*/part-00001*.json"))
    whole = file.read_bytes()
    file.write_bytes(whole + b'{"id": 99, "te')
    next((tmp_path / "log").glob("part-*/.part-00001*.crc")).unlink()
    with pytest.raises(ValueError, match="bytes are committed"):
        versions.read_log(spark, path, KIND)
    assert versions.recover(spark, path) == want and file.read_bytes() == whole
    assert versions.read_log(spark, path, KIND).count() == 10
    file.write_bytes(whole[:-3])
    with pytest.raises(ValueError, match="lost"):
        versions.recover(spark, path)


def test_empty_batches_two_writers_and_finished_logs(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    assert versions.progress(spark, path) == (0, 0, 0) and versions.read_log(spark, path, KIND).count() == 0
    assert versions.append(batch(spark, 0).limit(0), path, 0) and versions.progress(spark, path) == (1, 0, 0)
    real = versions._counted

    def slow(*args):
        monkeypatch.setattr(versions, "_counted", real)
        assert versions.append(batch(spark, 1), path, 1)
        return real(*args)

    monkeypatch.setattr(versions, "_counted", slow)
    assert not versions.append(batch(spark, 1), path, 1)
    assert versions.read_log(spark, path, KIND).count() == 10 and len(list((tmp_path / "log").glob("part-*"))) == 2
    versions.finish(spark, path)
    versions.finish(spark, path)
    with pytest.raises(ValueError, match="finished"):
        versions.append(batch(spark, 2), path, 2)
    assert json.loads((tmp_path / "log/_log/finished.json").read_text())["rows"] == 10


def test_a_stream_appends_each_row_once(spark, tmp_path):
    source, path, seen = tmp_path / "in", f"file://{tmp_path}/log", str(tmp_path / "check")
    source.mkdir()

    def run(predict):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(source))
        ingest.append_stream(stream, predict, path, seen).awaitTermination(120)

    (source / "a.json").write_text('{"id": 1}\n{"id": 2}')
    run(lambda b: b)
    (source / "b.json").write_text('{"id": 3}')
    with pytest.MonkeyPatch.context() as m:
        m.setattr(versions, "_counted", lambda *a: (_ for _ in ()).throw(Crash("breaks off")))
        with pytest.raises(Exception, match="breaks off"):
            run(lambda b: b)
    (source / "c.json").write_text('{"id": 4}')
    run(lambda b: b)
    assert sorted(r.id for r in versions.read_log(spark, path, "id long").collect()) == [1, 2, 3, 4]


def seen_by_reader(spark, path):
    v = versions.current(spark, path)
    return v and (sorted(r.id for r in v.table("train", KIND).collect()), sorted(r.id for r in v.table("dev", KIND).collect()), v.document("registry")["n"])


def test_a_reader_sees_one_whole_version_after_a_crash_at_any_step(spark, tmp_path):
    def tables(i):
        return {"train": batch(spark, i), "dev": batch(spark, i + 5)}

    def whole(i):
        return list(range(i * 10, i * 10 + 10)), list(range((i + 5) * 10, (i + 5) * 10 + 10)), i

    with pytest.MonkeyPatch.context() as m:
        seen = crash_at(m, -1)
        for i in range(3):
            versions.publish(tables(i), {"registry": {"n": i}}, f"file://{tmp_path}/steps", overwrite=True)
        n_steps = seen[0]
    assert n_steps == 3 * 4 + 1
    for k in range(2 * n_steps):
        path, done = f"file://{tmp_path}/v{k}", None
        with pytest.MonkeyPatch.context() as m:
            crash_at(m, k)
            with pytest.raises(Crash):
                for i in range(3):
                    done = i
                    versions.publish(tables(i), {"registry": {"n": i}}, path, overwrite=True)
        assert seen_by_reader(spark, path) in ([whole(done)] + [whole(done - 1) if done else None])
        versions.publish(tables(7), {"registry": {"n": 7}}, path, overwrite=True)
        assert seen_by_reader(spark, path) == whole(7)


def test_versions_that_are_read_stay_and_old_ones_go(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    first = versions.publish({"train": batch(spark, 0)}, {}, path)
    with pytest.raises(FileExistsError):
        versions.publish({"train": batch(spark, 1)}, {}, path)
    versions.publish({"train": batch(spark, 1)}, {}, path, overwrite=True)
    assert first.table("train", KIND).count() == 10
    versions.publish({"train": batch(spark, 2)}, {}, path, overwrite=True)
    assert len(list((tmp_path / "v").glob("version-*"))) == 2 and versions.current(spark, f"file://{tmp_path}/none") is None


def test_chat_tables_with_registry_and_layout(spark, tmp_path):
    path = f"file://{tmp_path}/chat"
    messages = spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], "messages array<struct<role:string,content:string>>")
    manifest = {"batch_size": 8, "files": {"train": {"rows": 9, "selector": 4}}, "train_selector_contrast_pairs": 1, "train_selector_unpaired_negatives": "2", "seed": 3, "input_directory": "in", "preparation_fingerprint": "f"}
    v = versions.publish_chat({"train": messages, "dev": messages}, "graph", path, manifest)
    entry = v.document("dataset_info")
    assert sorted(entry) == ["graph_dev", "graph_train"] and entry["graph_dev"]["file_name"] == "graph_dev.jsonl" and entry["graph_dev"]["tags"]["function_tag"] == "function"
    assert v.document("layout") == {"batch_size": 8, "train_rows": 9, "train_selector_rows": 4, "train_selector_contrast_pairs": 1, "train_selector_unpaired_negatives": 2, "input_directory": "in", "preparation_seed": 3, "preparation_fingerprint": "f"}
    assert v.table("graph_train.jsonl", "messages array<struct<role:string,content:string>>").first().messages[1].content == "a"
    del manifest["seed"]
    assert "input_directory" not in versions.layout(manifest)
