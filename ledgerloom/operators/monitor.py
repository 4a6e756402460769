"""Pipeline events: counts of stages, taken while rows pass (``observe``), and handed to callbacks."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger(__name__)
Callback = Callable[[str, dict], None]


class Monitor:
    """Callbacks (event, data) for the stages of a batch or a stream.

    Metrics are aggregates that Spark computes in the pass that makes the rows; nothing is read twice. A stage whose rows no action
    has made has no event. A callback that fails is logged and holds up nothing.
    """

    def __init__(self):
        self.callbacks: list[Callback] = []
        self.stages: list[tuple[str, Observation]] = []
        self.listener: StreamingQueryListener | None = None

    def add_callback(self, callback: Callback) -> None:
        self.callbacks.append(callback)

    def emit(self, event: str, data: dict) -> None:
        for callback in self.callbacks:
            try:
                callback(event, data)
            except Exception as e:
                log.warning("callback failed for %s: %s", event, e)

    def stage(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """``df``, observed: rows, and further aggregates by name."""
        measures = [F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]]
        if df.isStreaming:
            return df.observe(name, *measures)
        seen = Observation(f"{name}-{len(self.stages)}")
        self.stages.append((name, seen))
        return df.observe(seen, *measures)

    def run(self, action: Callable[[], object]) -> object:
        """Run an action over observed rows; then "started" and "finished", and between them an event for each stage, in order."""
        self.emit("started", {})
        out = action()
        for name, seen in self.stages:
            self.emit(name, dict(seen.get))
        self.stages = []
        self.emit("finished", {})
        return out

    def attach(self, spark: SparkSession) -> None:
        """From now on, events of observed streams: one a stage and micro-batch, with its number as ``batch``."""
        monitor = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                monitor.emit("started", {"id": str(event.id)})

            def onQueryProgress(self, event):
                for name, row in event.progress.observedMetrics.items():
                    monitor.emit(name, row.asDict() | {"batch": event.progress.batchId})

            def onQueryTerminated(self, event):
                monitor.emit("finished", {"id": str(event.id)})

        self.listener = Listener()
        spark.streams.addListener(self.listener)

    def detach(self, spark: SparkSession) -> None:
        if self.listener is not None:
            spark.streams.removeListener(self.listener)
            self.listener = None
