"""Bucketed silver: same upsert result, and the stored side is never shuffled."""

from __future__ import annotations

from alertledger.operators.parse import clean_rows
from alertledger.operators.upsert import to_silver, upsert, upsert_bucketed
from alertledger.plans.registry import _silver_run
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore

SF_SMALL = "/root/testdata/sf0.001"

BUCKETS = 8


def _bag(df):
    return sorted(tuple(r) for r in df.fillna("~").collect())


def test_bucketed_upsert_equals_upsert_and_skips_target_shuffle(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-bucketed"))
    run0 = _silver_run(spark, SF_SMALL, 0, fx.SILVER_NOW)
    run1 = _silver_run(spark, SF_SMALL, 1, fx.SILVER_NOW_2)
    store.write_bucketed(upsert(None, run0), "silver", "id", BUCKETS)
    target = store.read_bucketed("silver", "id", BUCKETS)
    merged = upsert_bucketed(target, run1, BUCKETS)
    assert _bag(merged) == _bag(upsert(upsert(None, run0), run1))
    # the older run into the newer silver changes nothing
    store.write_bucketed(merged, "silver", "id", BUCKETS)
    again = upsert_bucketed(store.read_bucketed("silver", "id", BUCKETS), run0, BUCKETS)
    assert _bag(again) == _bag(merged)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2        # of the incoming batch only
    assert plan.count("WindowGroupLimit") == 2                 # a hot id is cut down before and after the first


def test_bucketed_version_is_re_registered(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-bucketed-reg"))
    silver = upsert(None, to_silver(clean_rows(_silver_run(spark, SF_SMALL, 0, fx.SILVER_NOW))))
    version = store.write_bucketed(silver, "silver", "id", BUCKETS)
    spark.sql(f"DROP TABLE {store._table('silver', version)}")     # as if another session wrote it
    back = store.read_bucketed("silver", "id", BUCKETS)
    assert back.count() == silver.count()
    plan = upsert_bucketed(back, silver, BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_plain_silver_moves_into_buckets(spark):
    from alertledger.plans.medallion import commit_silver

    store = LayerStore(spark, scratch_dir(spark, "test-plain-then-bucketed"))
    run0, run1 = (_silver_run(spark, SF_SMALL, i, now) for i, now in ((0, fx.SILVER_NOW), (1, fx.SILVER_NOW_2)))
    commit_silver(store, run0)
    assert not store.is_bucketed("silver")
    for _ in range(2):
        commit_silver(store, run1, buckets=BUCKETS)
        assert store.is_bucketed("silver")
        assert _bag(store.read("silver")) == _bag(upsert(upsert(None, run0), run1))
    commit_silver(store, run0)  # and back
    assert not store.is_bucketed("silver") and store.read("silver").count() == upsert(upsert(None, run0), run1).count()
