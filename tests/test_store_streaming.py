"""Versioned store, idempotent batch commits and stream = batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from alertledger.plans import medallion
from alertledger.plans.registry import QUERIES
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore
from alertledger.streaming import jobs

SF_SMALL = "/root/testdata/sf0.001"


def _bag(df):
    return sorted(tuple(r) for r in df.fillna("~").collect())


def test_versions_and_tags(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-store"))
    df = spark.range(5).withColumnRenamed("id", "x")
    assert store.write(df, "t") == 1
    assert store.write(store.read("t").withColumn("x", F.col("x") + 1), "t") == 2  # rewrite from itself
    assert sorted(r.x for r in store.read("t").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.x for r in store.read("t", version=1).collect()) == [0, 1, 2, 3, 4]
    assert store.write(df, "t", tag="b7") == 3
    assert store.write(df, "t", tag="b7") == 3          # replay: no new version
    assert store.append(df, "a", tag="0") == 1
    assert store.append(df, "a", tag="0") == 1          # replay: no new segment
    assert store.append(df, "a", tag="1") == 2
    assert store.read("a").count() == 10
    store.write(df, "a")                                # a refresh replaces, later segments add to it
    store.append(df.limit(2), "a")
    assert store.read("a").count() == 7


def test_empty_batch_and_taken_folder(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-empty"))
    empty = fx.alerts_from_orders(spark, SF_SMALL).limit(0)
    medallion.bronze_to_silver(empty, store, now=fx.ntz(fx.SILVER_NOW))
    medallion.silver_to_gold(store)
    assert all(df.count() == 0 for df in medallion.layers(store).values())
    jobs.alert_batch_fn(store, silver_now=fx.ntz(fx.SILVER_NOW))(empty, "q-0")
    df = spark.range(3)
    df.write.parquet(f"{store.root}/two/v=000001")      # another writer's version 1
    store._next = lambda name: 1
    with pytest.raises(Exception, match="(?i)already.exists"):
        store.write(df, "two")


def test_replayed_batch_is_a_no_op(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-replay"))
    alerts = fx.alerts_from_orders(spark, SF_SMALL)
    fn = jobs.alert_batch_fn(store, bronze_now=fx.ntz(fx.BRONZE_NOW), silver_now=fx.ntz(fx.SILVER_NOW))
    fn(alerts, "q-0")
    first = _bag(store.read("silver"))
    fn(alerts, "q-0")                                       # the same batch delivered again
    assert _bag(store.read("silver")) == first
    assert store.read("bronze").count() == alerts.count()


def test_medallion_batch_equals_stream(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-medallion"))
    landing = fx.alerts_from_orders(spark, SF_SMALL)
    medallion.bronze_to_silver(landing, store, now=fx.ntz(fx.SILVER_NOW))
    medallion.silver_to_gold(store)
    batch_silver = store.read("silver").drop("_bronze_ingested_at", "_silver_processed_at")
    stream_silver = QUERIES["stream_silver"](spark, SF_SMALL).drop("_bronze_ingested_at", "_silver_processed_at")
    assert _bag(batch_silver) == _bag(stream_silver)
    counts = {r["layer"]: r["row_count"] for r in store.counts(["bronze", "silver", "gold_daily"]).collect()}
    assert counts["bronze"] == landing.count() and counts["silver"] == store.read("silver").count()


def test_changes_between_versions(spark):
    from alertledger.operators.changes import apply_changes
    store = LayerStore(spark, scratch_dir(spark, "test-changes"))
    before, after = fx.change_pair(spark, SF_SMALL)
    cols = ["id", "amount", "direction", "counterparty"]
    v1 = store.write(before.select(*cols), "mirror_src")
    v2 = store.write(after.select(*cols), "mirror_src")
    feed = store.changes_between("mirror_src", v1, v2)
    assert {r["_commit_version"] for r in feed.select("_commit_version").distinct().collect()} == {v2}
    assert _bag(apply_changes(store.read("mirror_src", v1), feed)) == _bag(store.read("mirror_src", v2))
