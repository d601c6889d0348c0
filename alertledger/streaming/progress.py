"""Admission and progress of streams (T6, S10): what a trigger may take, and counts of every micro-batch as a layer.

``admitted`` bounds a micro-batch by files or bytes, so a backlog is worked off in batches of a known size.
``ProgressLog`` is a streaming listener: the counters that a stream observes (``counted``) arrive with each
batch's progress and are appended to a layer, once a batch (the tag is query and batch), so counts of a running
stream are a query like any other.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from ..session import configure, scratch_dir
from ..sources import fixtures as fx
from ..sources.store import LayerStore
from .jobs import run_once

COUNTERS = "counters"
PROGRESS = "query string, batch_id long, input_rows long, counters map<string, long>"


def admitted(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """S6 with admission: a streaming read of a parquet folder that takes at most so many files, or about so many bytes, a trigger."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(f"{path}/*")


def counted(stream: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """``stream`` that reports ``counters`` (aggregates) with the progress of each micro-batch."""
    return stream.observe(COUNTERS, *(c.alias(name) for name, c in counters.items()))


class ProgressLog(StreamingQueryListener):
    """Appends (query, batch_id, input_rows, counters) of each finished micro-batch to the layer ``name``."""

    def __init__(self, store: LayerStore, name: str = "stream_progress"):
        self.store, self.name, self._one_at_a_time = store, name, threading.Lock()

    def record(self, progress) -> None:
        """One batch; known batches and triggers without data add nothing."""
        query, batch, rows = str(progress.id), int(progress.batchId), int(progress.numInputRows)
        tag, observed = f"{query}-{batch}", progress.observedMetrics.get(COUNTERS)
        seen = {k: int(v) for k, v in observed.asDict().items()} if observed else {}
        with self._one_at_a_time:  # listeners are called from a thread of their own
            if rows and not self.store.has_tag(self.name, tag):
                frame = self.store.spark.createDataFrame([(query, batch, rows, seen)], PROGRESS)
                self.store.append(frame, self.name, tag=tag)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.record(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_counted_events(spark: SparkSession, sf_dir: str, splits: int = 4) -> LayerStore:
    """A backlog of ``splits`` files of events worked off one file a trigger; layers ``events`` and ``stream_progress``."""
    configure(spark)
    root = scratch_dir(spark, "progress")
    store = LayerStore(spark, f"{root}/layers")
    events = fx.table(spark, sf_dir, "events")
    for i in range(splits):
        events.filter(F.col("event_id") % splits == i).coalesce(1).write.parquet(f"{root}/inbox/arrival={i:04d}")
    log = ProgressLog(store)
    spark.streams.addListener(log)
    try:
        stream = counted(admitted(spark, f"{root}/inbox", events.schema, max_files=1),
                         {"errors": F.count_if(F.col("event_type") == "error"), "users": F.count("user_id")})
        query = run_once(stream, lambda batch, tag: store.append(batch, "events", tag=tag), f"{root}/_checkpoint")
        for progress in query.recentProgress:  # listeners hear of a batch some time after it
            log.record(progress)
    finally:
        spark.streams.removeListener(log)
    return store
