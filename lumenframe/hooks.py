"""Where networks plug in: batch functions over tables, and listeners."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

_ESTIMATORS: dict[str, tuple[Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], str]] = {}


def register_estimator(name: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> None:
    """A batch function (decoder, descriptor, matcher, depth network) with the schema of what it yields."""
    _ESTIMATORS[name] = (function, schema)


def estimate(name: str, rows: DataFrame, done: DataFrame | None = None, key: str = "window") -> DataFrame:
    """Run an estimator over the rows that have no finished result yet."""
    if name not in _ESTIMATORS:
        raise KeyError(f"no estimator named {name}")
    if done is not None:
        rows = rows.join(done.select(key).distinct(), key, "left_anti")
    function, schema = _ESTIMATORS[name]
    return rows.mapInPandas(function, schema)


class StageTimes:
    """Seconds spent in named stages, added up over their entries; for a run's status document."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.entries: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.entries[name] = self.entries.get(name, 0) + 1

    def document(self) -> dict:
        return {"stage_seconds": {k: round(v, 3) for k, v in self.seconds.items()}, "stage_entries": dict(self.entries)}


class Recent:
    """What a viewer shows of a long run: the last ``kept`` samples, each thinned evenly to at most ``most`` items."""

    def __init__(self, kept: int, most: int):
        self.samples: deque = deque(maxlen=kept)
        self.most = most

    def add(self, items: Sequence) -> None:
        stride = max(1, -(-len(items) // self.most))
        self.samples.append(items[::stride])


class Progress(StreamingQueryListener):
    """Passes progress records on, at most one per ``seconds``; a failing callback never stops the query."""

    def __init__(self, callback: Callable[[dict], None], seconds: float = 0.2):
        self.callback, self.seconds, self.last = callback, seconds, 0.0

    def _send(self, record: dict, always: bool = False) -> None:
        if always or time.monotonic() - self.last >= self.seconds:
            self.last = time.monotonic()
            try:
                self.callback(record)
            except Exception:  # a viewer must not stop the run
                self.seconds = float("inf")

    def onQueryStarted(self, event) -> None:
        self._send({"stage": "started", "id": str(event.id)}, always=True)

    def onQueryProgress(self, event) -> None:
        self._send({"stage": "progress", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._send({"stage": "ended", "error": event.exception}, always=True)
