"""Tasks of the parse and buckets of silver grow with the orders; the rows stay."""

from __future__ import annotations

from alertledger.functions.columns import normalised_text
from alertledger.operators.parse import parse_fields
from alertledger.plans import registry
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore

SF_SMALL = "/root/testdata/sf0.001"  # 1,500 orders


def _bag(df):
    return sorted(map(repr, df.collect()))


def test_parse_tasks_and_buckets_grow_with_the_orders(spark, monkeypatch):
    assert registry._parse_tasks(spark, SF_SMALL) == 16
    few = _bag(registry.q_upsert_bucketed(spark, SF_SMALL))
    monkeypatch.setattr(fx, "ORDERS_PER_TASK", 75)
    assert registry._parse_tasks(spark, SF_SMALL) == 20 and fx.tasks_for_orders(spark, SF_SMALL, 8, ways=4) == 8
    plan = registry._parsed(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(20)" in plan
    many = registry.q_upsert_bucketed(spark, SF_SMALL)
    assert "20 out of 20" in many._jdf.queryExecution().executedPlan().toString()
    assert _bag(many) == few


def test_texts_are_built_after_the_orders_are_dealt(spark, monkeypatch):
    """One file of orders is one task or few; the texts are made in as many tasks as the orders ask for."""
    monkeypatch.setattr(fx, "ORDERS_PER_TASK", 50)
    alerts = fx.alerts_from_orders(spark, SF_SMALL)
    assert alerts.rdd.getNumPartitions() == 30
    plan = alerts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("format_number") < plan.index("Repartition 30")


def test_bucketed_silver_is_written_one_file_a_bucket(spark, monkeypatch):
    """Before, every task of the window wrote a file into each bucket."""
    monkeypatch.setattr(fx, "ORDERS_PER_TASK", 75)
    files = []
    read = LayerStore.read_bucketed

    def counted(self, name, *args):
        files.append(len(read(self, name, *args).inputFiles()))
        return read(self, name, *args)

    monkeypatch.setattr(LayerStore, "read_bucketed", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(registry, "configure", lambda s: s)
        registry.q_upsert_bucketed(spark, SF_SMALL)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files == [20]


def test_fallback_amounts_and_white_space_of_odd_texts(spark):
    """A fallback pattern runs only where the ones before it found nothing, and runs of odd white space become one space."""
    bodies = ["debited Rs.5.00 then Rs.7 credited", "Rs.7\tcredited now, Rs 9", "Rs\n\n11  noted", "\x0bnothing \x0c here", " ", None,
              "spent  Rs.,  and Rs.3 debited", "a  b Rs.4"]
    schema = "id string, sender string, subject string, body string, snippet string, event_time timestamp_ntz"
    bronze = spark.createDataFrame([(str(i), "s", None, b, None, None) for i, b in enumerate(bodies)], schema)
    got = parse_fields(bronze).select("id", "_text", normalised_text().alias("whole"), "amount").orderBy("id").collect()
    assert [r["_text"] for r in got] == [r["whole"] for r in got]
    assert [None if r["amount"] is None else float(r["amount"]) for r in got] == [5.0, 7.0, 11.0, None, None, None, None, 4.0]
    plan = parse_fields(bronze)._jdf.queryExecution().optimizedPlan().toString()
    guarded = plan.split("AS _raw_amount_generic")[0].rsplit("CASE WHEN", 2)
    assert "_raw_amount_anchored" in "".join(guarded[-2:]) or "_raw_amount_postfix" in "".join(guarded[-2:])


def test_texts_are_parsed_where_they_are_built(spark):
    """Before, the alerts' texts were shuffled once more between the orders' deal and the parse."""
    plan = registry._parsed(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange RoundRobinPartitioning(16)") == 1
