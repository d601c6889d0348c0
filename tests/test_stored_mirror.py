"""A mirror stored by its key: feeds and refreshes read the buckets, and rows without a key or repeated ones count as elsewhere."""

from __future__ import annotations

import pytest

from alertledger.operators import changes
from alertledger.session import scratch_dir
from alertledger.sources.store import LayerStore

SCHEMA = "id string, v int"
BEFORE = [("a", 1), ("b", 1), ("c", 1), ("c", 2), (None, 7), ("x", None)]
AFTER = [("a", 1), ("b", 2), ("d", 4), (None, 8), ("x", 3)]


def _bag(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def stored(spark):
    store = LayerStore(spark, scratch_dir(spark, "t-stored-mirror"))
    for name, rows in (("before", BEFORE), ("after", AFTER)):
        store.write_bucketed(spark.createDataFrame(rows, SCHEMA), name, "id", 4)
    return store, store.read_bucketed("before", "id", 4), store.read_bucketed("after", "id", 4)


def test_feed_of_stored_sides_is_the_feed_and_shuffles_no_keyed_row(spark, stored):
    _, before, after = stored
    plain = changes.change_feed(spark.createDataFrame(BEFORE, SCHEMA), spark.createDataFrame(AFTER, SCHEMA), "id")
    feed = changes.change_feed(before, after, "id", stored=True)
    assert _bag(feed) == _bag(plain)
    keyed = feed._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [coalesce")[0]
    assert "FullOuter" in keyed and "Exchange" not in keyed


def test_refresh_is_replay_and_shuffles_the_feed_only(spark, stored):
    store, before, after = stored
    feed = spark.createDataFrame(changes.change_feed(before, after, "id", version=2, stored=True).collect(),
                                 f"{SCHEMA}, {changes.CHANGE} string, {changes.SEQ} long")
    late = feed.selectExpr("id", "v + 100 AS v", changes.CHANGE, f"1L AS {changes.SEQ}")
    changes.store_mirror(store, "mirror", before, "id", 4)
    plain = changes.mirror_of(spark.createDataFrame(BEFORE, SCHEMA).filter("v IS NULL OR v <> 2"))
    for batch in (feed, late, feed):
        planned = changes.replay_stored(store.read_bucketed("mirror", "id", 4), batch, "id", 4)
        plan = planned._jdf.queryExecution().executedPlan().toString()  # the feed, and the rows without a key
        assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 2
        changes.refresh_mirror(store, "mirror", batch, "id", 4)
        plain = changes.replay(plain, batch, "id")
        assert _bag(changes.visible(store.read("mirror"))) == _bag(changes.visible(plain))
    assert _bag(changes.visible(store.read("mirror"))) == _bag(spark.createDataFrame(AFTER, SCHEMA))


def test_buckets_follow_the_rows(spark):
    assert changes.bucket_count(spark.range(10)) == 8
    assert changes.bucket_count(spark.range(10 * changes.ROWS_PER_BUCKET + 1)) == 11
