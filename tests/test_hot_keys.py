"""A key holding a third of all rows: results stay right and the plan pre-reduces before the shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertledger.operators import gold, ledger
from alertledger.operators.parse import clean_rows
from alertledger.plans.registry import _committed
from alertledger.operators.upsert import newest_per_key, to_silver, upsert
from alertledger.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def _hot_alerts(spark):
    """Driver-table alerts where every third message is a copy of message 'hot' (resent over time)."""
    a = fx.alerts_from_orders(spark, SF_SMALL, keep_parts=True)
    hot = (F.col("o_orderkey") % 3 == 0) & F.col("id").isNotNull()
    return (a.withColumn("id", F.when(hot, F.lit("hot")).otherwise(F.col("id")))
             .drop("o_orderkey", "o_custkey", "r", "k"))


def test_hot_id_newest_wins(spark):
    clean = to_silver(clean_rows(_committed(spark, _hot_alerts(spark), fx.SILVER_NOW)))
    n_hot = clean.filter(F.col("id") == "hot").count()
    assert n_hot > clean.count() / 4                    # the hot key really is hot
    newest = newest_per_key(clean).filter(F.col("id") == "hot").collect()
    assert len(newest) == 1
    assert newest[0]["event_time"] == clean.filter(F.col("id") == "hot").agg(F.max("event_time")).first()[0]
    plan = newest_per_key(clean)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan                            # per-task limit before the exchange
    merged = upsert(upsert(None, clean), clean)
    assert merged.filter(F.col("id") == "hot").count() == 1


def test_hot_merchant_and_day_aggregate_map_side(spark):
    silver = fx.ledger_orders(spark, SF_SMALL)
    hot = F.col("id").substr(-1, 1).isin("0", "3", "6")
    skewed = (silver.withColumn("counterparty", F.when(hot, F.lit("SHOP HOT")).otherwise(F.col("counterparty")))
                    .withColumn("effective_date", F.when(hot, F.lit(fx.AS_OF).cast("date"))
                                .otherwise(F.col("effective_date"))))
    top = ledger.top_merchants(skewed, "1990-01-01", "2030-01-01", 1).collect()
    assert top[0]["counterparty"] == "SHOP HOT"
    daily = gold.daily_summary(skewed.withColumn("event_time", F.col("effective_ts")))
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan
