"""Options not exercised by the registered queries: W8 "today" views, run filters, T6 trigger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from alertledger.operators import gold, ledger, ops
from alertledger.operators.parse import parse_alerts, quarantine_rows
from alertledger.schemas import LANDING
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore
from alertledger.streaming import jobs

SF_SMALL = "/root/testdata/sf0.001"


def _quarantine(spark, now: str):
    t = dt.datetime(2024, 1, 1, 9)
    rows = [("a", "t", "s", None, "me", "Rs.5 debited", "Rs.5 debited", t, t),
            ("b", "t", "s", "x", "me", "hello", "hello", t, t)]
    return quarantine_rows(parse_alerts(spark.createDataFrame(rows, LANDING), fx.ntz(now)))


def test_quarantine_grid_today_only(spark):
    q = _quarantine(spark, "2024-01-02 08:00:00")
    assert ledger.quarantine_grid(q, as_of="2024-01-02", today_only=True).count() == 2
    assert ledger.quarantine_grid(q, as_of="2024-01-03", today_only=True).count() == 0
    assert ledger.quarantine_grid(q, limit=1).count() == 1


def test_failure_list_today_only(spark):
    g = gold.failure_reason_counts(_quarantine(spark, "2024-01-02 08:00:00"))
    assert {r["Date"] for r in ledger.failure_list(g, "2024-01-01", today_only=True).collect()} == \
        {dt.date(2024, 1, 1)}
    assert ledger.failure_list(g, "2024-01-05", today_only=True).count() == 0


def test_runs_job_filter_and_latest(spark):
    runs = fx.runs_from_nation(spark, SF_SMALL)
    recon = spark.createDataFrame([(dt.date(2001, 7, 15), 3, 2, 1, 0, 66.67)],
                                  "txn_date date, ingested_count long, processed_count long, failed_count long, "
                                  "duplicates_dropped long, pass_rate_pct double")
    only_job0 = ops.runs_with_recon(runs, recon, job_ids=[0]).collect()
    assert only_job0 and all(r["job_id"] == 0 for r in only_job0)
    newest = ops.runs_with_recon(runs, recon, latest=10).collect()
    assert len(newest) == 10
    today = [r for r in newest if r["run_id"] == 0][0]       # run 0 starts on as_of
    assert today["ingested_count"] == 3 and today["txn_date"] == dt.date(2001, 7, 15)
    assert ops.runs_with_recon(None, recon).first()["run_id"] is None


def test_continuous_trigger_processes_arrivals(spark):
    root = scratch_dir(spark, "test-continuous")
    store = LayerStore(spark, f"{root}/layers")
    events = fx.table(spark, SF_SMALL, "events")
    events.write.parquet(f"{root}/inbox/arrival=0000")
    query = jobs.run_once(jobs.stream_layer(spark, f"{root}/inbox", events.schema),
                          jobs.dedup_sink_fn(store, "events_once", "event_id"),
                          f"{root}/_checkpoint", continuous=True, interval="1 second")
    try:
        query.processAllAvailable()
        events.filter(F.col("event_id") % 2 == 0).write.parquet(f"{root}/inbox/arrival=0001")  # re-sent ids
        query.processAllAvailable()
    finally:
        query.stop()
    assert store.read("events_once").count() == events.count()
