"""Structured Streaming front ends (S6, T1–T7) on the same batch transforms.

Streams read a folder of parquet files with ``readStream`` and a fixed schema
and process each micro-batch with ``foreachBatch``. Every batch commit is
tagged in the ``LayerStore`` with the id of the streaming query (which lives in
its checkpoint) and the batch number, so a replayed batch (after a driver
restart the last batch is re-delivered) is a no-op: exactly-once on top of an
at-least-once sink. A new checkpoint is a new query, whose batches are new.
Checkpoints live in the shared folder.

The registered queries simulate arrivals the way the scheduled job sees them:
one split of the input lands, a run-once (``availableNow``) trigger processes
what is new, the next split lands, and so on. ``continuous=True`` runs the same
``foreachBatch`` under a processing-time trigger instead (T6).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import changes, gold
from ..operators.months import MonthlySilver
from ..operators.parse import DQ, clean_rows, flagged, parse_alerts, quarantine_rows
from ..operators.upsert import changed_images, newest_per_key
from ..schemas import BRONZE, SILVER
from ..session import configure, scratch_dir
from ..sources import fixtures as fx, mailbox
from ..sources.ingest import commit_ingest, to_bronze
from ..plans.medallion import commit_silver, silver_target
from ..sources.store import LayerStore

BatchFn = Callable[[DataFrame, str], None]  # rows of a micro-batch, tag of the batch
PARSE_PARTITIONS = 16  # of the registered streams, at least


# ----------------------------------------------------------------- generic runner
def stream_layer(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Streaming read of a parquet folder (every file in its sub-folders)."""
    return spark.readStream.schema(schema).parquet(f"{path}/*")


def tagged(fn: BatchFn, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """``fn`` as a foreachBatch body: the tag is the query id in the checkpoint's metadata and the batch number."""
    query: list[str] = []

    def process(batch: DataFrame, batch_id: int) -> None:
        if not query:
            query.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        fn(batch, f"{query[0]}-{batch_id}")
    return process


def run_once(stream: DataFrame, fn: BatchFn, checkpoint: str, continuous: bool = False,
             interval: str = "10 seconds"):
    """Process what is available now (or keep running with a processing-time trigger)."""
    writer = stream.writeStream.foreachBatch(tagged(fn, checkpoint)).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def feed_in_arrivals(spark: SparkSession, root: str, arrivals: list[DataFrame], schema: StructType,
                     fn: BatchFn) -> None:
    """Land each arrival as new files, then run the stream once over what is new."""
    inbox, checkpoint = f"{root}/inbox", f"{root}/_checkpoint"
    for i, frame in enumerate(arrivals):
        frame.write.mode("overwrite").parquet(f"{inbox}/arrival={i:04d}")
        run_once(stream_layer(spark, inbox, schema), fn, checkpoint)


# ----------------------------------------------------------------- T1–T3: alerts → silver
def alert_batch_fn(store: LayerStore, source: str = "landing", bronze_now=None, silver_now=None,
                   silver_buckets: int | None = None, parse_partitions: int | None = None,
                   months: MonthlySilver | None = None) -> BatchFn:
    """foreachBatch body: bronze append → parse once → split → upsert silver.

    The batch is written to bronze first and re-read from there, so the parse
    reads committed files (no recomputation of the source) and runs once; the
    flagged rows are written once, split into clean / quarantine folders.

    With ``months`` silver is kept by month there and a batch rewrites the months it touches; without, silver is a
    layer of ``store``, rewritten per batch. Gold follows the images of what changed either way.
    """
    def process(batch: DataFrame, tag: str) -> None:
        store.append(to_bronze(batch, source, bronze_now), "bronze", tag=tag)
        parsed = flagged(parse_alerts(store.read_tag("bronze", tag, BRONZE), silver_now, parse_partitions))
        store.append(parsed, "parsed", tag=tag, partition_by=[DQ])
        committed = store.read_tag("parsed", tag, parsed.schema)
        clean = clean_rows(committed)
        if months is not None:
            months.commit(clean, tag)
        elif not store.has_tag("silver_images", tag):  # before the commit that they describe
            target, stored_buckets = silver_target(store, silver_buckets)
            store.append(changed_images(target, clean, buckets=stored_buckets), "silver_images", tag=tag)

        def commit() -> None:
            if months is None and not store.has_tag("silver", tag):
                commit_silver(store, clean, tag=tag, buckets=silver_buckets)

        def failures() -> None:
            if not store.has_tag("gold_failures", tag):
                batch_counts = gold.failure_reason_counts(quarantine_rows(committed))
                previous = store.read("gold_failures") if store.exists("gold_failures") else None
                store.write(add_counts(previous, batch_counts, ["txn_date", "reason"], "failure_count"),
                            "gold_failures", tag=tag)

        images = store.read_tag("silver_images", tag) if months is None else months.images(tag)
        silver = months.read if months is not None else lambda: store.read("silver", schema=SILVER)
        with ThreadPoolExecutor(2 + len(GOLD)) as pool:  # independent jobs; gold waits for silver only where it reads it
            committed_silver = pool.submit(commit)

            def silver_after() -> DataFrame:
                committed_silver.result()
                return silver()

            rest = [pool.submit(failures)] + [pool.submit(follow_images, store, name, images, silver_after, tag) for name in GOLD]
            for job in (committed_silver, *rest):
                job.result()
    return process


GOLD = {"gold_daily": gold.daily, "gold_merchant": gold.merchant}


def follow_images(store: LayerStore, name: str, images: DataFrame, silver: Callable[[], DataFrame], tag: str) -> None:
    """T5 by deltas: one gold table after the signed ``images`` of a commit. ``silver`` (after the commit) is read only for
    groups whose smallest or largest value left (``RollUp.apply``)."""
    if not store.has_tag(name, tag):
        roll_up, gold_now = GOLD[name](), store.read(name) if store.exists(name) else None
        store.append(roll_up.apply(gold_now, images), f"{name}_applied", tag=tag)
        store.write(roll_up.finish(store.read_tag(f"{name}_applied", tag), silver()), name, tag=tag)


def add_counts(previous: DataFrame | None, batch: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """T5 (failures): additive counts maintained per batch — old + new, summed per key.

    Exact for counts (quarantine only grows), and the state is one row per
    key (date × reason), so each batch costs O(days), not O(rows seen).
    """
    if previous is None:
        return batch
    return (previous.unionByName(batch).groupBy(*keys)
            .agg(F.sum(measure).cast("long").alias(measure)))


def run_alert_stream(spark: SparkSession, sf_dir: str, splits: int = 4, silver_buckets: int | None = 8,
                     by_month: bool = False) -> LayerStore:
    """The alerts arrive in ``splits`` parts; silver is kept bucketed by id, so each micro-batch shuffles only
    itself, or ``by_month``, so each rewrites only the months it touches."""
    configure(spark)
    parse_tasks = fx.tasks_for_orders(spark, sf_dir, PARSE_PARTITIONS, splits)
    if silver_buckets is not None:  # so many at least: a bucket is one task of each micro-batch
        silver_buckets = fx.tasks_for_orders(spark, sf_dir, silver_buckets)
    root = scratch_dir(spark, "alert-stream")
    store = LayerStore(spark, f"{root}/layers")
    alerts = fx.alerts_from_orders(spark, sf_dir, keep_parts=True)
    landing_cols = [c for c in alerts.columns if c not in ("o_orderkey", "o_custkey", "r", "k")]
    schema = alerts.select(*landing_cols).schema
    part = (F.col("o_orderkey") + F.col("r")) % splits
    store.write(alerts.select(*landing_cols, part.alias("_arrival")), "outbox", partition_by=["_arrival"])
    sent = store.read("outbox")
    arrivals = [sent.filter(F.col("_arrival") == i).select(*landing_cols) for i in range(splits)]
    feed_in_arrivals(spark, root, arrivals, schema,
                     alert_batch_fn(store, bronze_now=fx.ntz(fx.BRONZE_NOW), silver_now=fx.ntz(fx.SILVER_NOW),
                                    silver_buckets=silver_buckets, parse_partitions=parse_tasks,
                                    months=MonthlySilver(spark, f"{root}/silver") if by_month else None))
    return store


def run_alert_stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_alert_stream(spark, sf_dir).read("silver")


def run_alert_stream_gold(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """T5: ``gold_daily`` or ``gold_merchant`` as the alert stream keeps it, by deltas."""
    return run_alert_stream(spark, sf_dir).read(name)


def run_restarted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a stream whose checkpoint is lost starts again over new files; its batch 0 is not the old batch 0."""
    configure(spark)
    root = scratch_dir(spark, "restarted")
    store = LayerStore(spark, f"{root}/layers")
    events = fx.table(spark, sf_dir, "events")
    for i in range(2):
        feed_in_arrivals(spark, f"{root}/run{i}", [events.filter(F.col("event_id") % 2 == i)], events.schema,
                         dedup_sink_fn(store, "events_once", "event_id"))
    return store.read("events_once")


def run_alert_stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_alert_stream(spark, sf_dir).read("gold_failures")


# ----------------------------------------------------------------- T5: streaming daily gold
def daily_events(stream: DataFrame) -> DataFrame:
    return (stream.groupBy(F.to_date("ts").alias("txn_date"), "event_type")
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value")))


def keyed_replace_fn(store: LayerStore, name: str, keys: list[str]) -> BatchFn:
    """Update-mode sink: batch rows replace the stored rows with the same key."""
    def process(batch: DataFrame, tag: str) -> None:
        if store.has_tag(name, tag):
            return
        fresh = batch.withColumn("_seq", F.lit(1))
        if store.exists(name):
            fresh = store.read(name).withColumn("_seq", F.lit(0)).unionByName(fresh)
        merged = newest_per_key(fresh, keys, [F.col("_seq").desc()]).drop("_seq")
        store.write(merged, name, tag=tag)
    return process


def run_events_daily_stream(spark: SparkSession, sf_dir: str, splits: int = 4) -> DataFrame:
    """T5: per-day, per-type event counts maintained by a streaming aggregation.

    Update mode with no watermark: state is one row per (day, type), which
    grows by days, not by events, and late rows still land in the right day.
    """
    configure(spark)
    root = scratch_dir(spark, "events-daily")
    store = LayerStore(spark, f"{root}/layers")
    events = fx.table(spark, sf_dir, "events")
    arrivals = [events.filter(F.col("event_id") % splits == i) for i in range(splits)]
    inbox, checkpoint = f"{root}/inbox", f"{root}/_checkpoint"
    sink = keyed_replace_fn(store, "gold_events_daily", ["txn_date", "event_type"])
    for i, frame in enumerate(arrivals):
        frame.write.mode("overwrite").parquet(f"{inbox}/arrival={i:04d}")
        agg = daily_events(stream_layer(spark, inbox, events.schema))
        q = (agg.writeStream.outputMode("update").foreachBatch(tagged(sink, checkpoint))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return store.read("gold_events_daily")


# ----------------------------------------------------------------- T4: exactly-once ingest
def dedup_sink_fn(store: LayerStore, name: str, key: str) -> BatchFn:
    """Append only ids never seen before (within the batch and across batches)."""
    def process(batch: DataFrame, tag: str) -> None:
        if store.has_tag(name, tag):
            return
        fresh = newest_per_key(batch, key, [])  # of copies that differ, always the same one
        if store.exists(name):
            fresh = fresh.join(store.read(name).select(key), key, "left_anti")
        store.append(fresh, name, tag=tag)
    return process


def run_events_dedup_stream(spark: SparkSession, sf_dir: str, splits: int = 4) -> DataFrame:
    """T4: events re-sent across batches (every 3rd id again in the next split) land once."""
    configure(spark)
    root = scratch_dir(spark, "events-dedup")
    store = LayerStore(spark, f"{root}/layers")
    events = fx.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    arrivals = []
    for i in range(splits):
        first = events.filter(eid % splits == i)
        resent = events.filter((eid % 3 == 0) & ((eid + 1) % splits == i))
        arrivals.append(first.unionByName(resent))
    feed_in_arrivals(spark, root, arrivals, events.schema, dedup_sink_fn(store, "events_once", "event_id"))
    return store.read("events_once")


# ----------------------------------------------------------------- T7: mirror refresh
def mirror_fn(store: LayerStore, name: str, key: str, buckets: int) -> BatchFn:
    """Refresh the mirror ``name``, which ``changes.store_mirror`` stored into ``buckets`` by ``key``."""
    def process(batch: DataFrame, tag: str) -> None:
        if store.has_tag(name, tag):
            return
        changes.refresh_mirror(store, name, batch, key, buckets, tag=tag)
    return process


def run_mirror_stream(spark: SparkSession, sf_dir: str, splits: int = 2) -> DataFrame:
    """A serving copy of ``before`` follows the change feed to ``after``."""
    from ..plans.registry import _bucketed_pair
    configure(spark)
    root = scratch_dir(spark, "mirror")
    store = LayerStore(spark, f"{root}/layers")
    before, after, buckets = _bucketed_pair(spark, sf_dir, store)
    changes.store_mirror(store, "mirror", before, "id", buckets)
    feed = changes.change_feed(before, after, "id", stored=True)
    bucket = F.pmod(F.xxhash64("id"), F.lit(splits))
    arrivals = [feed.filter(bucket == i) for i in range(splits)]
    feed_in_arrivals(spark, root, arrivals, feed.schema, mirror_fn(store, "mirror", "id", buckets))
    return changes.visible(store.read("mirror"))


def run_mirror_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of the second commit arrives first, the first one's late, and the second's once more."""
    from ..plans.registry import _bucketed_pair
    configure(spark)
    root = scratch_dir(spark, "mirror-late")
    store = LayerStore(spark, f"{root}/layers")
    before, after, buckets = _bucketed_pair(spark, sf_dir, store)
    middle = after.withColumn("amount", (F.col("amount") + 5).cast("decimal(18,2)"))
    changes.store_mirror(store, "mirror", before, "id", buckets)
    one = changes.change_feed(before, middle, "id", version=1, stored=True)
    two = changes.change_feed(middle, after, "id", version=2, stored=True)
    feed_in_arrivals(spark, root, [two, one, two], one.schema, mirror_fn(store, "mirror", "id", buckets))
    return changes.visible(store.read("mirror"))


# ----------------------------------------------------------------- S4/S6: the mailbox as a stream
def mailbox_fn(store: LayerStore, threads: DataFrame, now_micros: int) -> BatchFn:
    """foreachBatch body: new messages of the mailbox source to ``landing``, their ids to ``seen``; not messages to ``unread_lines``."""
    def process(batch: DataFrame, tag: str) -> None:
        store.append(batch, "mail", tag=tag)  # the source is read once
        mail = store.read_tag("mail", tag, batch.schema)
        store.append(mail.filter("raw IS NOT NULL").select("raw"), "unread_lines", tag=tag)
        commit_ingest(store, threads, mail.filter("raw IS NULL").drop("raw"), now_micros, tag)
    return process


def run_mailbox_stream(spark: SparkSession, sf_dir: str, now_micros: int, splits: int = 3) -> LayerStore:
    """The mailbox export grows by a part of the messages; each time the stream goes on from its checkpoint."""
    configure(spark)
    mailbox.register(spark)
    root = scratch_dir(spark, "mailbox")
    store = LayerStore(spark, f"{root}/layers")
    threads, messages, seen = fx.mail_threads(spark, sf_dir)
    store.append(seen, "seen", tag="start")
    part = F.pmod(F.xxhash64("id"), F.lit(splits))
    for i in range(splits):
        mailbox.export_messages(messages.filter(part == i), f"{root}/export", i)
        stream = spark.readStream.format("mailbox").option("path", f"{root}/export").load()
        run_once(stream, mailbox_fn(store, threads, now_micros), f"{root}/_checkpoint")
    return store
