"""Deep pages read few parts; micro-batches are bounded and counted once."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from alertledger.operators import paging
from alertledger.operators.ledger import ledger_page
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore
from alertledger.streaming import progress

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    ledger = fx.ledger_orders(spark, SF_SMALL)
    tied = ledger.withColumn("effective_ts", F.when(F.col("id").endswith("3"), F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz"))
                             .when(F.col("id").endswith("4"), None).otherwise(F.col("effective_ts")))
    store = LayerStore(spark, scratch_dir(spark, "t-pages"))
    paging.build_page_index(tied, store, rows_per_part=100)
    return store, tied


@pytest.mark.parametrize("page", [0, 3, 4, 17, 59, 60, 5000])
def test_page_equals_offset_and_reads_few_parts(spark, index, page):
    store, tied = index
    deep = paging.indexed_page(store, page, 25, paging.page_schema(tied))
    assert [tuple(r) for r in deep.collect()] == [tuple(r) for r in ledger_page(tied, page, 25).collect()]
    plan = deep._jdf.queryExecution().executedPlan().toString()
    parts = set(re.findall(r"_part#\d+ IN \(([^)]*)\)|_part#\d+ = (\d+)", re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1])) if "PartitionFilters: [" in plan else set()
    assert all(len((many or one).split(",")) <= 2 for many, one in parts)
    assert len(store.read("ledger_pages_parts").collect()) >= 10


@pytest.mark.parametrize("page", [0, 7, 31, 59])
def test_folders_follow_the_rows_not_the_parts(spark, page):
    ledger = fx.ledger_orders(spark, SF_SMALL)
    store = LayerStore(spark, scratch_dir(spark, "t-small-parts"))
    paging.build_page_index(ledger, store, rows_per_part=3)  # 500 parts
    folders = store.read("ledger_pages_parts").collect()
    assert len(folders) <= paging.MIN_FOLDERS and sum(r["rows"] for r in folders) == ledger.count()
    deep = paging.indexed_page(store, page, 25, paging.page_schema(ledger))
    assert [tuple(r) for r in deep.collect()] == [tuple(r) for r in ledger_page(ledger, page, 25).collect()]


def test_backlog_is_worked_off_in_bounded_batches(spark):
    store = progress.run_counted_events(spark, SF_SMALL, splits=3)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    log = store.read("stream_progress").orderBy("batch_id").collect()
    want = {r["b"]: r["n"] for r in events.groupBy((F.col("event_id") % 3).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert {r["batch_id"]: r["input_rows"] for r in log} == want and len(log) == 3
    assert sum(r["counters"]["errors"] for r in log) == events.filter("event_type = 'error'").count()
    assert store.read("events").count() == events.count()


def test_a_batch_is_logged_once_and_bytes_bound_it(spark):
    root = scratch_dir(spark, "t-bytes")
    for i in range(4):
        spark.range(1000).coalesce(1).write.parquet(f"{root}/inbox/arrival={i}")
    store = LayerStore(spark, f"{root}/layers")
    log = progress.ProgressLog(store)
    stream = progress.admitted(spark, f"{root}/inbox", spark.range(1).schema, max_bytes="1")
    query = (stream.writeStream.foreachBatch(lambda batch, i: batch.count()).option("checkpointLocation", f"{root}/_c").trigger(availableNow=True).start())
    query.awaitTermination()
    for _ in range(2):
        for p in query.recentProgress:
            log.record(p)
    assert [r["input_rows"] for r in store.read("stream_progress").orderBy("batch_id").collect()] == [1000] * 4
