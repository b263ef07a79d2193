"""Adaptive replay: a stream with restarts and crashes, and a table, against a plain loop."""

import hashlib
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import replay


def md5(*keys):
    return hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()


def loop(events, s):
    """One run after the other, with a deque."""
    out = []
    for run in {e["run"] for e in events}:
        memory, threshold, baseline, added, last = deque(maxlen=s.capacity), s.threshold, 0.0, 0, None
        for e in sorted((e for e in events if e["run"] == run), key=lambda e: e["seq"]):
            if e["seq"] == last:
                continue
            last = e["seq"]
            if e["kind"] == "validation":
                if e["loss"] >= baseline + s.slack:
                    threshold, baseline = min(1.0, threshold + 0.1), e["loss"]
                out.append((run, last, None, None, threshold, len(memory), None))
                continue
            p = {"constant": 0.5, "increasing": e["progress"], "decreasing": 1 - e["progress"]}[s.schedule] * threshold
            u, held, sampled = int(md5(s.seed, run, last)[:12], 16) / 2**48, len(memory), None
            if u < p or (u < threshold and held < s.capacity):
                source = "fresh"
                for f in e["features"] or []:
                    memory.append((added, f))
                    added += 1
            elif u < threshold and held >= s.batch:
                source, sampled = "replay", [f for _, f in sorted(memory, key=lambda x: md5(s.seed, run, last, x[0]))[: s.batch]]
            else:
                source = "dataset"
            out.append((run, last, source, p, threshold, held, sampled))
    return sorted(out)


def events(seed, runs=4, n=120):
    r = random.Random(seed)
    out = []
    for k in range(runs):
        for i in range(n):
            if r.random() < 0.2:
                out.append({"run": f"r{k}", "seq": i, "kind": "validation", "progress": None, "features": None, "loss": r.random() * 3})
            else:
                out.append({"run": f"r{k}", "seq": i, "kind": "step", "progress": i / n, "features": [f"{k}-{i}-{j}" for j in range(r.randint(0, 3))], "loss": None})
    return out


def rows(df):
    return sorted((r.run, r.seq, r.source, r.fresh_probability, r.threshold, r.held, r.sampled) for r in df.collect())


def put(folder, name, part):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, part)))


@pytest.mark.parametrize("schedule", ["constant", "increasing", "decreasing"])
def test_a_table_against_the_loop(spark, schedule):
    s = replay.Settings(capacity=7, batch=3, threshold=0.4, slack=0.2, schedule=schedule, seed=5)
    all_events = events(1) + events(1)[:50]
    df = spark.createDataFrame([tuple(e.values()) for e in all_events], replay.EVENT).repartition(5, F.rand(1))
    got = rows(replay.replay_table(df, s))
    assert got == loop(all_events, s) and {x[2] for x in got} == {None, "fresh", "replay", "dataset"}


def test_a_stream_that_stops_crashes_and_repeats_files(spark, tmp_path, monkeypatch):
    s = replay.Settings(capacity=6, batch=2, threshold=0.5, slack=0.1, seed=3)
    all_events = sorted(events(2, 3, 60), key=lambda e: e["seq"])
    source = tmp_path / "in"

    def start():
        stream = spark.readStream.schema(replay.EVENT).option("maxFilesPerTrigger", 1).json(str(source))
        return replay.replay_stream(stream, s, str(tmp_path / "out"), str(tmp_path / "check"))

    put(source, "a", all_events[:50])
    start().awaitTermination(120)
    # A file that is delivered again, one that breaks off the query within a batch, and one after it.
    put(source, "b", all_events[30:80])
    put(source, "c", all_events[80:120] + [{**all_events[0], "seq": 1000, "kind": "nonsense"}])
    with pytest.raises(Exception, match="neither a step"):
        start().awaitTermination(120)
    put(source, "c", all_events[80:120])
    put(source, "d", all_events[120:])
    start().awaitTermination(120)
    start().awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == loop(all_events, s)


def test_settings_are_checked():
    for bad in ({"capacity": 0, "batch": 1}, {"capacity": 1, "batch": 0}, {"capacity": 1, "batch": 1, "threshold": 1.5}, {"capacity": 1, "batch": 1, "slack": -1}, {"capacity": 1, "batch": 1, "schedule": "x"}):
        with pytest.raises(ValueError):
            replay.Settings(**bad)


def test_an_empty_table(spark):
    assert replay.replay_table(spark.createDataFrame([], replay.EVENT), replay.Settings(1, 1)).count() == 0
