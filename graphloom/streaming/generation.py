"""Answers of a model for rows of prompts, in order and resumable, and the progress of such a run.

The model is a seam: a function that makes a predictor, once for each Python worker. Rows are dealt into batches by a budget of tokens.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.sampling import number
from ..sources import versions

#: A predictor takes a list of prompts and gives as many answers.
Predictor = Callable[[list[str]], list[str]]

_LOADED: dict[str, Predictor] = {}


def budgeted(sizes: list[int], budget: int) -> Iterator[slice]:
    """Stretches of neighbours whose number times the largest size stays within a budget; what alone is beyond it stands alone."""
    at, most = 0, 0
    for i, n in enumerate(sizes):
        if i > at and max(most, n) * (i + 1 - at) > budget:
            yield slice(at, i)
            at, most = i, 0
        most = max(most, n)
    if sizes:
        yield slice(at, len(sizes))


def generate(prompts: DataFrame, make: Callable[[], Predictor], model: str, budget: int, key: str = "id", prompt: str = "prompt", n_tokens: str = "n_tokens") -> DataFrame:
    """(key, answer). A worker makes the predictor of a model name once and keeps it; answers follow their prompts, whatever the batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model not in _LOADED:
            _LOADED[model] = make()
        predict = _LOADED[model]
        for pdf in batches:
            # Neighbours of like length waste least.
            pdf = pdf.sort_values(n_tokens, kind="stable")
            answers: list[str] = []
            for part in budgeted(pdf[n_tokens].tolist(), budget):
                asked = pdf[prompt].tolist()[part]
                got = predict(asked)
                if len(got) != len(asked):
                    raise ValueError(f"{len(asked)} prompts, {len(got)} answers")
                answers += got
            yield pd.DataFrame({key: pdf[key].tolist(), "answer": answers})

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, prompt, n_tokens).mapInPandas(run, f"{key} {kind}, answer string")


def generate_log(prompts: DataFrame, make: Callable[[], Predictor], model: str, budget: int, path: str, rows_per_batch: int, key: str = "id", on_batch: Callable[[int, int], None] | None = None) -> int:
    """Answers of all prompts, appended to the log under path in the order of key; returns how many rows this run added.

    A run that broke off goes on behind its last commit: rows are numbered in the order of key, and a batch is a stretch of numbers. The prompts must be those of the
    first run. on_batch is told the rows done and all rows after each batch.
    """
    spark = prompts.sparkSession
    numbered = number(prompts, [key], "row_")
    total, (first, done, _) = numbered.count(), versions.recover(spark, path)
    if done != min(total, first * rows_per_batch):
        raise ValueError(f"{path} has {done} rows in {first} batches: not of these prompts or of this batch size")
    for batch in range(first, -(-total // rows_per_batch)):
        part = numbered.where(F.col("row_").between(batch * rows_per_batch, (batch + 1) * rows_per_batch - 1))
        versions.append(generate(part, make, model, budget, key), path, batch)
        if on_batch:
            on_batch(min(total, (batch + 1) * rows_per_batch), total)
    return total - done


class Progress:
    """Lines on how far a run is, with its rate and the time that is left, at most one in ``every`` seconds; the last one always."""

    def __init__(self, total: int | None, say: Callable[[str], None] = print, every: float = 10.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.total, self.say, self.every, self.clock = total, say, every, clock
        self.began, self.told, self.start = clock(), None, None

    def __call__(self, done: int, total: int | None = None) -> None:
        now, total = self.clock(), self.total if total is None else total
        self.start = 0 if self.start is None else self.start
        last = total is not None and done >= total
        if self.told is not None and now - self.told < self.every and not last:
            return
        self.told = now
        spent = max(now - self.began, 1e-9)
        rate = (done - self.start) / spent
        left = "" if total is None else f" of {total}, {_duration((total - done) / rate) if rate > 0 else '?'} left"
        self.say(f"{done} rows{left}, {rate:.1f} rows a second, {_duration(spent)} so far")


def _duration(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


class StreamProgress(StreamingQueryListener):
    """Progress of the rows that streaming queries have read, all or those of one name."""

    def __init__(self, progress: Progress, name: str | None = None) -> None:
        self.progress, self.name, self.rows, self.lock = progress, name, 0, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is None or p.name == self.name:
            with self.lock:
                self.rows += p.numInputRows
                self.progress(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watched(spark: SparkSession, listener: StreamProgress):
    """The session's streams report to a listener until remove() of what this returns is called."""
    spark.streams.addListener(listener)

    class _Watch:
        @staticmethod
        def remove() -> None:
            spark.streams.removeListener(listener)

    return _Watch()
