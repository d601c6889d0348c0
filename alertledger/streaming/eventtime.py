"""Event-time jobs whose state is bounded by a lateness (T4, T5, A3/A4 as streams).

The lateness is defined in one place, the gate: a row is late if its time is at or before the newest time of all
earlier batches less the allowed delay. Late rows go to a layer of their own, the others to the on-time layer, so
nothing is lost. The jobs behind the gate read the on-time layer as a stream with a watermark of the same delay;
their watermark never passes the gate's, so they drop nothing:

* ``once_per_key``: exactly-once ids; the state store forgets an id when the watermark has passed its time by the
  delay, instead of remembering all ids ever seen;
* ``closed_days``: daily gold in append mode: a day is emitted once, when no more rows of it can come, and its state
  goes;
* ``DayCounts``: reconciliation as arbitrary state: counters per day, and a timer that emits the day. A day's rows are
  spread over ``salts`` keys, so a day with a third of all rows is no hot task; the sink adds the parts up.

Zone-less times are read as UTC, whatever the session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import gold
from ..session import configure, scratch_dir
from ..sources import fixtures as fx
from ..sources.store import LayerStore
from .jobs import BatchFn, feed_in_arrivals, run_once, stream_layer, tagged

CLOCK = "_clock"


def instant(time_col: str) -> Column:
    """A zone-less time as the instant that it is in UTC (watermarks need instants)."""
    return F.concat(F.col(time_col).cast("string"), F.lit("Z")).cast("timestamp")


def utc_date(moment: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86_400).cast("int"))


# ----------------------------------------------------------------- the gate
def gate_fn(store: LayerStore, on_time: str, late: str, time_col: str, delay: str) -> BatchFn:
    """foreachBatch body: rows of a batch to the layer ``on_time`` or ``late``; rows without time are late.

    The newest time of each batch is kept in a layer of one row a batch. A batch that is delivered again finds
    the clock of the other batches as it was, and its own commits done.
    """
    clock = f"{on_time}{CLOCK}"

    def process(batch: DataFrame, tag: str) -> None:
        if store.has_tag(clock, tag):
            return
        spark = batch.sparkSession
        newest = store.read(clock).agg(F.max("newest")).first()[0] if store.exists(clock) else None
        known = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        passed = F.col(time_col).isNull() | F.coalesce(F.col(time_col) <= known, F.lit(False))
        marked = batch.withColumn("_late", passed)
        store.append(marked, f"{on_time}_gated", tag=tag, partition_by=["_late"])  # the batch is read once
        gated = store.read_tag(f"{on_time}_gated", tag, marked.schema)
        store.append(gated.filter("NOT _late").drop("_late"), on_time, tag=tag)
        store.append(gated.filter("_late").drop("_late"), late, tag=tag)
        top = gated.agg(F.max(time_col).alias("newest")).first()[0]
        store.append(spark.createDataFrame([(top,)], "newest timestamp_ntz"), clock, tag=tag)
    return process


# ----------------------------------------------------------------- T4: bounded exactly-once
def once_per_key(stream: DataFrame, key: str, time_col: str, delay: str) -> DataFrame:
    """Rows of ``stream`` whose key was not seen within ``delay`` (of event time) before; state is bounded by the delay."""
    timed = stream.withColumn("_moment", instant(time_col)).withWatermark("_moment", delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_moment")


# ----------------------------------------------------------------- T5: append-mode gold
def closed_days(stream: DataFrame, roll_up: gold.RollUp, time_col: str, delay: str) -> DataFrame:
    """The groups of a daily roll-up, each once, when its day is closed."""
    keyed = roll_up.keyed(stream).withColumn("_moment", instant(time_col)).withWatermark("_moment", delay)
    keys = [k for k in roll_up.keys if k != "txn_date"]
    days = keyed.groupBy(F.window("_moment", "1 day").alias("_day"), *keys).agg(*roll_up.aggregates())
    return days.select(utc_date(F.col("_day.start")).alias("txn_date"), *keys, *roll_up.measures)


# ----------------------------------------------------------------- A3/A4: reconciliation with timers
SOURCES = ("landing", "silver", "quarantine")
COUNTS = "txn_date date, salt int, landing long, silver long, quarantine long"


class DayCounts(StatefulProcessor):
    """Counts of a (day, salt) by source; the timer at the end of the day emits them and forgets the day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counts = handle.getValueState("counts", "landing long, silver long, quarantine long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = list(self._counts.get()) if self._counts.exists() else [0, 0, 0]
        for frame in rows:
            for i, n in frame["src"].value_counts().items():
                counts[int(i)] += int(n)
        self._counts.update(tuple(counts))
        self._handle.registerTimer(int((pd.Timestamp(key[0]) + pd.Timedelta(days=1)).value // 1_000_000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts = self._counts.get()
        self._counts.clear()
        yield pd.DataFrame([(key[0], key[1], *counts)], columns=["txn_date", "salt", *SOURCES])

    def close(self) -> None:
        pass


def recon_days(stream: DataFrame, time_col: str, delay: str, salts: int = 8) -> DataFrame:
    """Counts of closed days from ``stream`` (time, src: 0 landing, 1 silver, 2 quarantine), in up to ``salts`` rows a day."""
    moment = instant(time_col)
    rows = stream.select(moment.alias("_moment"), utc_date(moment).alias("txn_date"), "src",
                         F.pmod(F.xxhash64(time_col, F.rand()), F.lit(salts)).cast("int").alias("salt"))
    return (rows.withWatermark("_moment", delay).groupBy("txn_date", "salt")
            .transformWithStateInPandas(DayCounts(), COUNTS, "Append", "EventTime"))


def recon_sink_fn(store: LayerStore, name: str) -> BatchFn:
    """Adds up the parts of each day (they are emitted in one batch: one watermark) and appends the day's row."""
    def process(batch: DataFrame, tag: str) -> None:
        summed = batch.groupBy("txn_date").agg(*(F.sum(c).alias(c) for c in SOURCES)).filter("landing > 0")
        store.append(gold.recon_row(summed, *SOURCES), name, tag=tag)
    return process


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ----------------------------------------------------------------- runners
def append_layer(store: LayerStore, name: str) -> BatchFn:
    return lambda batch, tag: store.append(batch, name, tag=tag)


def run_through(spark: SparkSession, root: str, arrivals: list[DataFrame], store: LayerStore, gate: BatchFn, on_time: str,
                schema: StructType, job: Callable[[DataFrame], DataFrame], sink: BatchFn,
                progress: list | None = None, mode: str = "append") -> None:
    """Each arrival through the gate, then ``job`` over what is new on time: two run-once queries per arrival, each
    restarted from its checkpoint. ``progress`` collects the state rows after each run of the job."""
    inbox = f"{root}/inbox"
    for i, frame in enumerate(arrivals):
        frame.write.mode("overwrite").parquet(f"{inbox}/arrival={i:04d}")
        run_once(stream_layer(spark, inbox, schema), gate, f"{root}/_gate")
        stream = job(stream_layer(spark, f"{store.root}/{on_time}", schema))
        query = (stream.writeStream.outputMode(mode).foreachBatch(tagged(sink, f"{root}/_job"))
                 .option("checkpointLocation", f"{root}/_job").trigger(availableNow=True).start())
        query.awaitTermination()
        if progress is not None:
            operators = [p for p in query.recentProgress if p["stateOperators"]]
            if operators:
                progress.append(operators[-1]["stateOperators"][0]["numRowsTotal"])


EVENT_DELAY = "4 days"
EVENT_ARRIVALS = 14


def event_arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three days of events an arrival; every 3rd id once more in the next one, every 11th id first comes four arrivals late."""
    events = fx.table(spark, sf_dir, "events")
    slot = F.floor((F.dayofmonth("ts") - 1) / 3).cast("int")
    eid = F.col("event_id")
    first = events.withColumn("_at", slot + F.when(eid % 11 == 0, 4).otherwise(0))
    resent = events.filter(eid % 3 == 0).withColumn("_at", slot + F.when(eid % 11 == 0, 4).otherwise(0) + 1)
    every = first.unionByName(resent)
    return [every.filter(F.col("_at") == i).drop("_at") for i in range(EVENT_ARRIVALS + 1)]


def run_dedup_watermark(spark: SparkSession, sf_dir: str, progress: list | None = None) -> LayerStore:
    """T4 with bounded state: layers ``events_once`` and ``events_late``."""
    configure(spark)
    root = scratch_dir(spark, "dedup-watermark")
    store = LayerStore(spark, f"{root}/layers")
    run_through(spark, root, event_arrivals(spark, sf_dir), store,
                gate_fn(store, "events", "events_late", "ts", EVENT_DELAY), "events",
                fx.table(spark, sf_dir, "events").schema,
                lambda stream: once_per_key(stream, "event_id", "ts", EVENT_DELAY),
                append_layer(store, "events_once"), progress)
    return store


LEDGER_DELAY = "30 days"
LEDGER_ARRIVALS = 4


def _period(time_col: str) -> Column:
    """Two years an arrival."""
    return F.least(F.greatest(F.floor((F.year(time_col) - fx.FIRST_YEAR) / 2), F.lit(0)), F.lit(LEDGER_ARRIVALS - 1)).cast("int")


def ledger_arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The ledger by periods of its event time; every 17th row comes one period later."""
    ledger = fx.ledger_orders(spark, sf_dir)
    n = F.substring_index("id", "-", -1).cast("long")
    at = F.least(_period("event_time") + F.when(n % 17 == 0, 1).otherwise(0), F.lit(LEDGER_ARRIVALS - 1))
    return [ledger.filter(at == i) for i in range(LEDGER_ARRIVALS)]


def run_gate(spark: SparkSession, sf_dir: str) -> LayerStore:
    """The gate alone: layers ``ledger`` and ``ledger_late``."""
    configure(spark)
    root = scratch_dir(spark, "gate")
    store = LayerStore(spark, f"{root}/layers")
    arrivals = ledger_arrivals(spark, sf_dir)
    feed_in_arrivals(spark, root, arrivals, arrivals[0].schema, gate_fn(store, "ledger", "ledger_late", "event_time", LEDGER_DELAY))
    return store


def run_closed_days(spark: SparkSession, sf_dir: str, progress: list | None = None) -> LayerStore:
    """T5 in append mode: layers ``gold_daily_closed`` and ``ledger_late``."""
    configure(spark)
    root = scratch_dir(spark, "closed-days")
    store = LayerStore(spark, f"{root}/layers")
    arrivals = ledger_arrivals(spark, sf_dir)
    run_through(spark, root, arrivals, store, gate_fn(store, "ledger", "ledger_late", "event_time", LEDGER_DELAY), "ledger",
                arrivals[0].schema, lambda stream: closed_days(stream, gold.daily(), "event_time", LEDGER_DELAY),
                append_layer(store, "gold_daily_closed"), progress)
    return store


def run_recon_stream(spark: SparkSession, sf_dir: str, layers: dict[str, DataFrame], progress: list | None = None) -> LayerStore:
    """A3/A4 as a stream over landing, silver and quarantine rows: layer ``gold_recon_closed``; rows without time are in ``recon_late``."""
    configure(spark)
    root = scratch_dir(spark, "recon-stream")
    store = LayerStore(spark, f"{root}/layers")
    parts = [layers[name].select("event_time", F.lit(i).alias("src")) for i, name in enumerate(("bronze", "silver", "silver_quarantine"))]
    store.write(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_at", _period("event_time")), "rows", partition_by=["_at"])
    rows = store.read("rows")
    arrivals = [rows.filter(F.coalesce("_at", F.lit(0)) == i).select("event_time", "src") for i in range(LEDGER_ARRIVALS)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what arbitrary state with timers is kept in
    try:
        run_through(spark, root, arrivals, store, gate_fn(store, "events", "recon_late", "event_time", LEDGER_DELAY), "events",
                    arrivals[0].schema, lambda stream: recon_days(stream, "event_time", LEDGER_DELAY),
                    recon_sink_fn(store, "gold_recon_closed"), progress)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return store
