"""Adaptive replay as a stateful operator: a bounded first-in-first-out buffer and a threshold for each run, kept across restarts.

Events of a run, in the order of ``seq``, are steps (progress from 0 to 1, and the features that a fresh rollout would give) and validations (a loss). A step
draws its source: fresh (its features enter the buffer), replay (a sample of the buffer, once it holds a batch) or the dataset. A validation whose
loss reaches that of the last one that raised the threshold, plus a slack, raises it by 0.1.

State is one small row for each run and one row for each place of its buffer: adding a feature writes one place, a sample reads a batch of places,
and no run's buffer is ever read as a whole. Draws depend on seed, run and seq alone. An event at or before
the last one seen is a repeat and changes nothing, so a file that is delivered twice does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Rocks DB is the state store that the operator needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

EVENT = "run string, seq long, kind string, progress double, features array<string>, loss double"
OUTCOME = "run string, seq long, source string, fresh_probability double, threshold double, held long, sampled array<string>"

# Fixed value: how far a validation raises the threshold.
RAISE = 0.1


@dataclass(frozen=True)
class Settings:
    """capacity: features that a buffer holds at most. batch: features in a sample. schedule: how fresh steps go with progress."""

    capacity: int
    batch: int
    threshold: float = 0.0
    slack: float = 0.1
    schedule: str = "decreasing"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.capacity < 1 or self.batch < 1 or not 0 <= self.threshold <= 1 or self.slack < 0:
            raise ValueError("capacity and batch are positive, the threshold lies from 0 to 1, the slack is not negative")
        if self.schedule not in ("constant", "increasing", "decreasing"):
            raise ValueError(f"unknown schedule {self.schedule!r}")

    def fresh_probability(self, threshold: float, progress: float) -> float:
        progress = min(max(progress, 0.0), 1.0)
        return threshold * {"constant": 0.5, "increasing": progress, "decreasing": 1.0 - progress}[self.schedule]


def _draw(*keys: object) -> str:
    return hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()


def advance(settings: Settings, run: str, state: tuple, event: tuple, places) -> tuple[tuple, tuple]:
    """State and outcome after an event. state: threshold, loss that it last rose at, features added so far, last seq. places: get(i) and put(i, feature) of the buffer."""
    threshold, baseline, added, _ = state
    seq, kind, progress, features, loss = event
    if kind == "validation" and loss == loss and loss is not None:
        if loss >= baseline + settings.slack:
            threshold, baseline = min(1.0, threshold + RAISE), loss
        return (threshold, baseline, added, seq), (run, seq, None, None, threshold, min(added, settings.capacity), None)
    if kind != "step" or progress is None or progress != progress:
        raise ValueError(f"run {run!r}, event {seq}: neither a step with its progress nor a validation with its loss")
    held = min(added, settings.capacity)
    u = int(_draw(settings.seed, run, seq)[:12], 16) / float(1 << 48)
    fresh, sampled = settings.fresh_probability(threshold, progress), None
    if u < fresh or (u < threshold and held < settings.capacity):
        source = "fresh"
        for feature in [] if features is None else features:
            places.put(added % settings.capacity, feature)
            added += 1
    elif u < threshold and held >= settings.batch:
        source = "replay"
        picked = sorted(range(added - held, added), key=lambda n: _draw(settings.seed, run, seq, n))[: settings.batch]
        sampled = [places.get(n % settings.capacity) for n in picked]
    else:
        source = "dataset"
    return (threshold, baseline, added, seq), (run, seq, source, fresh, threshold, held, sampled)


_COLUMNS = ["seq", "kind", "progress", "features", "loss"]


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    return zip(*(pdf[c].tolist() for c in _COLUMNS))


class Replay(StatefulProcessor):
    """advance() over the events of a micro-batch, in order, with the state in Spark's store."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run_state = handle.getValueState("run", "threshold double, baseline double, added long, last long")
        self.buffer = handle.getMapState("buffer", "place long", "feature string")

    def get(self, place: int) -> str | None:
        found = self.buffer.getValue((place,))
        return None if found is None else found[0]

    def put(self, place: int, feature: str | None) -> None:
        self.buffer.updateValue((place,), (feature,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.run_state.get()) if self.run_state.exists() else (self.settings.threshold, 0.0, 0, None)
        # A micro-batch is bounded by the source's limit for each trigger.
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for event in _rows(batch):
            if state[3] is None or event[0] > state[3]:
                state, outcome = advance(self.settings, key[0], state, event, self)
                out.append(outcome)
        if out:
            self.run_state.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"held": "int64", "seq": "int64"})

    def close(self) -> None:
        pass


def replayed(events: DataFrame, settings: Settings) -> DataFrame:
    """Outcomes of a stream of events (columns of EVENT). Rows of a run must come in order over micro-batches; within one they are sorted."""
    events.sparkSession.conf.set(*PROVIDER)
    typed = events.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in EVENT.split(", ")])
    return typed.groupBy("run").transformWithStateInPandas(Replay(settings), OUTCOME, "Append", "None")


def replay_stream(events: DataFrame, settings: Settings, out: str, checkpoint: str) -> StreamingQuery:
    """Outcomes as Parquet under out, each once, whatever stops the query and however often it starts again from its checkpoint."""
    return replayed(events, settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class _Places(dict):
    put = dict.__setitem__


def replay_table(events: DataFrame, settings: Settings) -> DataFrame:
    """The same outcomes of a whole table. A run's events are streamed in order: memory holds one buffer, whatever their number. Repeated seqs of a run count once."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state, places = None, None, _Places()
        for pdf in batches:
            out = []
            for name, event in zip(pdf["run"].tolist(), _rows(pdf)):
                if state is None or name != run:
                    run, state, places = name, (settings.threshold, 0.0, 0, None), _Places()
                if state[3] is None or event[0] > state[3]:
                    state, outcome = advance(settings, run, state, event, places)
                    out.append(outcome)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"held": "int64", "seq": "int64"})

    typed = events.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in EVENT.split(", ")])
    return typed.repartition("run").sortWithinPartitions("run", "seq").mapInPandas(go, OUTCOME)
