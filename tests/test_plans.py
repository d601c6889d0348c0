"""Physical-plan shape: the properties the library's scale story relies on."""

from __future__ import annotations

import pytest

from alertledger.operators import ledger
from alertledger.operators.parse import EXTRACTS, clean_rows, parse_alerts
from alertledger.operators.upsert import newest_per_key
from alertledger.plans.registry import QUERIES, _flagged
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore

SF_SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_per_key_has_partial_group_limit(spark):
    p = plan(newest_per_key(clean_rows(_flagged(spark, SF_SMALL))))
    # one limit before the exchange (per map task) and one after it
    assert p.count("WindowGroupLimit") == 2
    assert "Partial" in p and "Final" in p


def _stored_parse(spark):
    path = scratch_dir(spark, "test-landing")
    fx.alerts_from_orders(spark, SF_SMALL).write.parquet(path)
    return parse_alerts(spark.read.parquet(path), fx.ntz(fx.SILVER_NOW))


def test_parse_lets_filters_and_pruning_through(spark):
    parsed = _stored_parse(spark)
    late = formatted(spark, parsed.filter("event_time > timestamp_ntz'2000-01-01'"))
    pushed = [ln for ln in late.splitlines() if ln.startswith("PushedFilters")][0]
    assert "GreaterThan(event_time" in pushed

    def extracts(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")

    assert extracts(parsed) == len(EXTRACTS) == 13       # each pattern once
    assert extracts(parsed.select("id", "txn_ref")) == 1


def test_committed_split_runs_no_pattern(spark):
    text = formatted(spark, clean_rows(_flagged(spark, SF_SMALL)))
    assert "regexp_extract" not in text
    assert "PartitionFilters: [isnotnull(_dq" in text


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("stream_")
                                  and n != "ledger_csv"])
def test_no_pairwise_joins(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def formatted(spark, df) -> str:
    utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


def test_stored_silver_prunes_and_pushes(spark):
    store = LayerStore(spark, scratch_dir(spark, "test-plans"))
    store.write(fx.ledger_orders(spark, SF_SMALL), "silver")
    top = ledger.top_merchants(store.read("silver"), fx.RANGE_START, fx.RANGE_END, 7)
    text = formatted(spark, top)
    assert "TakeOrderedAndProject" in text
    assert "partial_sum" in text                         # map-side combine before the shuffle
    pushed = [ln for ln in text.splitlines() if ln.startswith("PushedFilters")][0]
    assert "GreaterThanOrEqual(effective_date" in pushed and "EqualTo(direction,DEBIT)" in pushed
    read_schema = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")][0]
    for col in ("counterparty", "amount", "direction", "effective_date"):
        assert col in read_schema
    assert "sender" not in read_schema and "txn_ref" not in read_schema
