"""Properties of the pipeline on frames derived from the driver tables (sf0.001)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alertledger.operators import changes, gold
from alertledger.operators.parse import clean_rows, parse_alerts, quarantine_rows, with_counters
from alertledger.operators.upsert import newest_per_key, to_silver, upsert
from alertledger.schemas import LANDING, SILVER
from alertledger.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_alerts(fx.alerts_from_orders(spark, SF_SMALL), fx.ntz(fx.SILVER_NOW)).cache()


def _bag(df, cols=None):
    cols = cols or df.columns
    return sorted(tuple(r) for r in df.select(*cols).fillna("~").collect())


def test_split_exhaustive_and_disjoint(parsed):
    n = parsed.count()
    c, q = clean_rows(parsed).count(), quarantine_rows(parsed).count()
    assert n == c + q > 0
    assert parsed.filter(F.col("failure_reasons").isNull()).count() == 0


def test_clean_rows_are_inr_and_positive(parsed):
    bad = clean_rows(parsed).filter((F.col("currency") != "INR") | (F.col("amount") <= 0)
                                    | ~F.col("direction").isin("DEBIT", "CREDIT"))
    assert bad.count() == 0


def test_upsert_order_insensitive_and_newer_wins(spark, parsed):
    clean = to_silver(clean_rows(parsed))
    older = clean.filter(F.col("event_time") < F.lit("1998-01-01").cast("timestamp_ntz"))
    newer = clean.filter(F.col("event_time") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    a = upsert(upsert(None, older), newer)
    b = upsert(upsert(None, newer), older)
    assert _bag(a) == _bag(b) == _bag(newest_per_key(clean))


def test_upsert_idempotent(spark, parsed):
    silver = upsert(None, to_silver(clean_rows(parsed)))
    again = upsert(silver, to_silver(clean_rows(parsed)))
    assert _bag(again) == _bag(silver)


def test_older_never_overwrites_newer(spark):
    t1, t2 = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)
    row = ("a", "t", "s", "alerts@hdfc", "me", "Rs.5 debited", "Rs.5 debited", t1, t1)
    old = ("a", "t", "s", "alerts@hdfc", "me", "Rs.9 debited", "Rs.9 debited", t2, t2)
    tie = ("a", "t", "s", "alerts@hdfc", "me", "Rs.7 debited", "Rs.7 debited", t1, t1)
    target = upsert(None, to_silver(parse_alerts(spark.createDataFrame([row], LANDING))))
    for other in (old, tie):
        merged = upsert(target, to_silver(parse_alerts(spark.createDataFrame([other], LANDING))))
        assert [r["amount"] for r in merged.collect()] == [5], "older or equal event_time must not replace"


def test_null_target_time_is_never_replaced(spark):
    t = dt.datetime(2024, 1, 1)
    target = spark.createDataFrame([("a", None)], "id string, event_time timestamp_ntz")
    target = target.select(*[F.col(c) if c in ("id", "event_time") else F.lit(None).cast(f.dataType).alias(c)
                             for c, f in ((f.name, f) for f in SILVER.fields)]).withColumn("bank", F.lit("OLD"))
    src = target.withColumn("event_time", F.lit(t).cast("timestamp_ntz")).withColumn("bank", F.lit("NEW"))
    assert [r["bank"] for r in upsert(target, src).collect()] == ["OLD"]


def test_recon_adds_up(spark, parsed):
    bronze = fx.alerts_from_orders(spark, SF_SMALL)
    silver = upsert(None, to_silver(clean_rows(parsed)))
    recon = gold.recon_metrics(bronze, silver, quarantine_rows(parsed)).collect()
    for r in recon:
        assert r["ingested_count"] == (r["processed_count"] + r["failed_count"] + r["duplicates_dropped"]) \
            or r["duplicates_dropped"] == 0
    assert sum(r["ingested_count"] for r in recon) == bronze.count()


def test_change_feed_round_trip(spark):
    before, after = fx.change_pair(spark, SF_SMALL)
    cols = ["id", "amount", "direction", "counterparty", "effective_date"]
    before, after = before.select(*cols), after.select(*cols)
    feed = changes.change_feed(before, after, "id")
    kinds = {r["_change_type"] for r in feed.select("_change_type").distinct().collect()}
    assert kinds == {"insert", "update", "delete"}
    assert _bag(changes.apply_changes(before, feed, "id")) == _bag(after)
    # replaying the same feed again changes nothing
    once = changes.apply_changes(before, feed, "id")
    assert _bag(changes.apply_changes(once, feed, "id")) == _bag(after)


def test_empty_input(spark):
    empty = spark.createDataFrame([], LANDING)
    p = parse_alerts(empty)
    assert p.count() == 0
    assert gold.daily_summary(upsert(None, to_silver(clean_rows(p)))).count() == 0
    assert gold.recon_metrics(empty, to_silver(clean_rows(p)), quarantine_rows(p)).count() == 0


def test_quality_counters_come_with_the_write(spark):
    from pyspark.sql import Observation
    obs = Observation("alert_dq_test")
    parsed = parse_alerts(fx.alerts_from_orders(spark, SF_SMALL), fx.ntz(fx.SILVER_NOW))
    with_counters(parsed, obs).write.format("noop").mode("overwrite").save()      # the one action
    counts = obs.get
    assert counts["rows"] == parsed.count()
    assert counts["clean_rows"] == clean_rows(parsed).count()
    assert 0 < counts["rows_with_amount"] <= counts["rows"]
    assert counts["invalid_amount"] == parsed.filter("array_contains(failure_reasons, 'invalid_amount')").count() > 0


def test_null_key_and_composite_keys(spark):
    schema = "k string, l int, v int"
    before = spark.createDataFrame([(None, 1, 1), ("a", None, 1), ("b", 2, 1)], schema)
    after = spark.createDataFrame([(None, 1, 2), ("a", None, 1), ("c", 2, 1)], schema)
    feed = changes.change_feed(before, after, ["k", "l"])
    assert sorted((r["_change_type"], r["k"], r["v"]) for r in feed.collect()) == \
        [("delete", "b", 1), ("insert", "c", 1), ("update", None, 2)]
    assert _bag(changes.apply_changes(before, feed, ["k", "l"])) == _bag(after)


def test_late_and_replayed_changes_lose(spark):
    mirror = changes.mirror_of(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"))
    schema = "id string, v int, _change_type string, _commit_version long"
    one = spark.createDataFrame([("a", 10, "update", 1), ("b", 10, "update", 1)], schema)
    two = spark.createDataFrame([("a", 20, "update", 2), ("b", 1, "delete", 2)], schema)
    for order in ((one, two), (two, one), (two, one, two, one)):
        state = mirror
        for feed in order:
            state = changes.replay(state, feed)
        assert [tuple(r) for r in changes.visible(state).collect()] == [("a", 20)]
