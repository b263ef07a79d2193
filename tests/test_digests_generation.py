"""File digests by ranges, coverage by bitmaps, generation behind a seam, progress."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coverage
from graphloom.sources import digests, versions
from graphloom.streaming import generation


def test_digests_by_ranges(spark, tmp_path):
    sizes = [0, 1, 9, 10, 11, 19, 20, 21, 95, 100]
    for n in sizes:
        (tmp_path / f"f {n}.bin").write_bytes(random.Random(n).randbytes(n))
    files = digests.listed(spark, f"file://{tmp_path}")
    body = lambda r: (tmp_path / r.path.rpartition("/")[2].replace("%20", " ")).read_bytes()
    got = digests.sampled(files, 10).collect()
    assert sorted(r.size for r in got) == sizes[1:]
    for r in got:
        b = body(r)
        assert r.digest == hashlib.sha256(b[:10] + (b[-10:] if len(b) > 10 else b"")).hexdigest() and r.fetched == min(len(b), 10) * (1 + (len(b) > 10))
    for r in digests.full(files, 10).collect():
        b = body(r)
        parts = [hashlib.sha256(b[i : i + 10]).hexdigest() for i in range(0, max(len(b), 1), 10)]
        assert r.digest == hashlib.sha256("\n".join(parts).encode()).hexdigest() and r.fetched == len(b)
    one = digests.fingerprint(digests.full(files), "s")
    (tmp_path / "f 95.bin").write_bytes(b"x" * 95)
    assert one != digests.fingerprint(digests.full(digests.listed(spark, f"file://{tmp_path}")), "s")


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    with (tmp_path / "big").open("wb") as f:
        f.write(b"head" * 5000)
        f.seek((5 << 29) - 4)
        f.write(b"tail")
    r = digests.sampled(digests.listed(spark, f"file://{tmp_path}/big")).first()
    n = digests.SAMPLE
    assert r.size == 5 << 29 and r.fetched == 2 * n
    assert r.digest == hashlib.sha256((b"head" * 5000).ljust(n, b"\0") + b"tail".rjust(n, b"\0")).hexdigest()


def test_coverage_of_groups(spark):
    r = random.Random(4)
    left = [(f"g{r.randrange(5)}", r.randrange(60000)) for _ in range(3000)] + [("only", 1), (None, 2), ("g1", None)]
    right = [x for x in left if r.random() < 0.999 or x[0] == "g2"] + [("g3", 70000), ("new", 5), (None, 2)]
    got = {x.g: tuple(x)[1:] for x in coverage.compare(*(spark.createDataFrame(x, "g string, u int") for x in (left, right)), "g", "u").collect()}
    sets = lambda rows: {g: {u for h, u in rows if h == g and u is not None} for g, _ in left + right}
    a, b = sets(left), sets(right)
    assert got == {g: (len(a[g]), len(b[g]), len(a[g] - b[g]), len(b[g] - a[g]), a[g] == b[g]) for g in a}
    same = spark.createDataFrame(left, "g string, u int")
    assert coverage.require_equal(same, same, "g", "u").count() == len(a) - 1
    with pytest.raises(Exception, match="coverage differs in g3"):
        coverage.require_equal(same.where("g = 'g3'"), spark.createDataFrame(right, "g string, u int").where("g = 'g3'"), "g", "u").collect()


def prompts(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("p"), "id").alias("prompt"), (F.col("id") % 7 + 1).cast("int").alias("n_tokens")).repartition(3)


def fake(folder):
    """A model that notes each load and each batch."""

    def make():
        import os
        import uuid

        (folder / f"load-{os.getpid()}-{uuid.uuid4().hex}").touch()

        def predict(texts):
            (folder / f"batch-{len(texts)}-{uuid.uuid4().hex}").touch()
            return [t.upper() for t in texts]

        return predict

    return make


def test_one_model_for_each_worker_and_batches_by_budget(spark, tmp_path):
    got = generation.generate(prompts(spark, 200), fake(tmp_path), f"fake-{tmp_path}", 30)
    assert {r.id: r.answer for r in got.collect()} == {i: f"P{i}" for i in range(200)}
    loads = [p.name.split("-")[1] for p in tmp_path.glob("load-*")]
    assert len(loads) == len(set(loads)) <= 4 and max(int(p.name.split("-")[1]) for p in tmp_path.glob("batch-*")) <= 30
    parts = list(generation.budgeted([1, 1, 1, 9, 50, 2, 2], 10))
    assert [(p.start, p.stop) for p in parts] == [(0, 3), (3, 4), (4, 5), (5, 7)] and list(generation.budgeted([], 5)) == []
    with pytest.raises(Exception, match="prompts, 1 answers"):
        generation.generate(prompts(spark, 9), lambda: lambda texts: ["x"], f"short-{tmp_path}", 100).collect()


def test_a_run_goes_on_behind_its_last_commit(spark, tmp_path):
    path, seen = f"file://{tmp_path}/log", []

    def breaks(done, total):
        seen.append((done, total))
        if len(seen) == 2:
            raise RuntimeError("breaks off")

    args = (fake(tmp_path), f"resume-{tmp_path}", 50, path, 10)
    with pytest.raises(RuntimeError):
        generation.generate_log(prompts(spark, 35), *args, on_batch=breaks)
    assert generation.generate_log(prompts(spark, 35), *args) == 15 and generation.generate_log(prompts(spark, 35), *args) == 0
    rows = versions.read_log(spark, path, "id long, answer string").collect()
    assert sorted((r.id, r.answer, r.batch) for r in rows) == [(i, f"P{i}", i // 10) for i in range(35)] and seen == [(10, 35), (20, 35)]
    with pytest.raises(ValueError, match="not of these prompts"):
        generation.generate_log(prompts(spark, 12), *args)


def test_progress_is_throttled_and_tells_what_is_left():
    now, said = [0.0], []
    p = generation.Progress(100, said.append, every=10, clock=lambda: now[0])
    for t, done in ((5, 10), (6, 20), (14.9, 30), (15, 50), (16, 99), (17, 100)):
        now[0] = t
        p(done)
    assert said == ["10 rows of 100, 00:00:45 left, 2.0 rows a second, 00:00:05 so far", "50 rows of 100, 00:00:15 left, 3.3 rows a second, 00:00:15 so far", "100 rows of 100, 00:00:00 left, 5.9 rows a second, 00:00:17 so far"]


def test_progress_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(f'{{"id": {j}}}' for j in range(5)))
    said, now = [], [0.0]

    def clock():
        now[0] += 1
        return now[0]

    listener = generation.StreamProgress(generation.Progress(20, said.append, every=0, clock=clock), "counted")
    watch = generation.watched(spark, listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(50):
            if listener.rows == 20:
                break
            time.sleep(0.2)
    finally:
        watch.remove()
    assert listener.rows == 20 and said[-1].startswith("20 rows of 20") and said[0].startswith("5 rows of 20")
