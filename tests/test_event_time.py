"""Event-time jobs: state stays bounded, late rows are kept aside, nothing is lost, a re-delivered batch changes nothing."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from alertledger.session import scratch_dir
from alertledger.sources.store import LayerStore
from alertledger.streaming import eventtime as et

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, v long"


def days(spark, day, ids, shift=0):
    return spark.createDataFrame([(i, T0 + timedelta(days=day + shift, minutes=i), i) for i in ids], SCHEMA)


def test_dedup_state_does_not_grow(spark):
    """Ten days of 50 new ids, each day the ids of the day before once more: the state holds the delay's days, not all ids."""
    root = scratch_dir(spark, "t-dedup")
    store = LayerStore(spark, f"{root}/layers")
    arrivals = [days(spark, d, range(100 * d, 100 * d + 50)).unionByName(days(spark, d, range(100 * (d - 1), 100 * (d - 1) + 50), -1) if d
                else days(spark, 0, [])) for d in range(10)]
    late = days(spark, 0, [7, 8])
    arrivals[6] = arrivals[6].unionByName(late)
    state = []
    et.run_through(spark, root, arrivals, store, et.gate_fn(store, "events", "late", "ts", "2 days"), "events",
                   arrivals[0].schema, lambda s: et.once_per_key(s, "event_id", "ts", "2 days"), et.append_layer(store, "once"), state)
    once = [r["event_id"] for r in store.read("once").collect()]
    assert sorted(once) == [100 * d + i for d in range(10) for i in range(50)]
    assert sorted(r["event_id"] for r in store.read("late").collect()) == [7, 8]
    assert len(state) == 10 and max(state) <= 4 * 50 and state[-1] <= max(state[3:6])


def test_gate_commits_a_batch_once_and_keeps_rows_without_time(spark):
    store = LayerStore(spark, scratch_dir(spark, "t-gate"))
    gate = et.gate_fn(store, "on_time", "late", "ts", "1 day")
    batch = days(spark, 5, [1, 2]).unionByName(spark.createDataFrame([(3, None, 3)], SCHEMA))
    for tag in ("a", "a"):
        gate(batch, tag)
    gate(days(spark, 5, [4], -1).unionByName(days(spark, 5, [5], -2)), "b")
    gate(days(spark, 5, [4], -1), "b")
    gate(days(spark, 0, []), "empty")
    gate(days(spark, 6, [6]), "c")
    assert sorted(r["event_id"] for r in store.read("on_time").collect()) == [1, 2, 4, 6]
    assert sorted(r["event_id"] for r in store.read("late").collect()) == [3, 5]


def test_closed_days_are_emitted_once(spark):
    from alertledger.operators.gold import RollUp

    root = scratch_dir(spark, "t-days")
    store = LayerStore(spark, f"{root}/layers")
    roll_up = RollUp(keys={"txn_date": F.to_date("ts"), "odd": F.col("v") % 2}, measures={"n": ("count", "*"), "top": ("max", "v")})
    arrivals = [days(spark, d, range(4)).unionByName(days(spark, d, [9], -1)) for d in range(6)]
    state = []
    et.run_through(spark, root, arrivals, store, et.gate_fn(store, "events", "late", "ts", "1 day"), "events", arrivals[0].schema,
                   lambda s: et.closed_days(s, roll_up, "ts", "1 day"), et.append_layer(store, "closed"), state)
    closed = [tuple(r) for r in store.read("closed").orderBy("txn_date", "odd").collect()]
    on_time = roll_up.summary(roll_up.keyed(store.read("events"))).filter(F.col("txn_date") < F.lit("2024-01-05").cast("date"))
    assert closed == [tuple(r) for r in on_time.orderBy("txn_date", "odd").collect()] and len(closed) == 2 * 4 + 1
    assert max(state) <= 2 * 4


def test_recon_counts_parts_of_a_hot_day(spark):
    root = scratch_dir(spark, "t-recon")
    store = LayerStore(spark, f"{root}/layers")
    day = [(T0 + timedelta(days=d, hours=h), src) for d in (0, 40, 80) for src, n in ((0, 300), (1, 200), (2, 50)) for h in range(n // 50) for _ in range(50)]
    rows = spark.createDataFrame(day, "event_time timestamp_ntz, src int")
    arrivals = [rows.filter(F.col("event_time") < "2024-01-20"), rows.filter(F.col("event_time").between("2024-01-20", "2024-03-01")),
                rows.filter(F.col("event_time") > "2024-03-01")]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, et.ROCKS)
    try:
        et.run_through(spark, root, arrivals, store, et.gate_fn(store, "events", "late", "event_time", "1 day"), "events",
                       rows.schema, lambda s: et.recon_days(s, "event_time", "1 day"), et.recon_sink_fn(store, "recon"))
    finally:
        spark.conf.set(key, before)
    found = [tuple(r)[1:] for r in store.read("recon").orderBy("txn_date").collect()]
    assert found == [(300, 200, 50, 50, 66.67)] * 2
