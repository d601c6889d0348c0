"""Benchmark: the alert-to-ledger chain and its serving queries at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs the batch chain (landing → bronze → parsed → silver, then the four gold
tables; one warm-up run into a throwaway store, then one timed run), then times the registered ledger / KPI / paging / change-feed queries
over the *committed* layers — the way the dashboard reads them — plus a few
lazy end-to-end queries straight from the driver tables. Each query is forced
to completion with the ``noop`` sink; the reported time is the median of
``BENCH_REPEAT`` warm runs. Prints exactly one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from alertledger.operators import changes, gold, ledger, ops  # noqa: E402
from alertledger.plans import medallion  # noqa: E402
from alertledger.operators.parse import clean_rows  # noqa: E402
from alertledger.plans.registry import PARSE_PARTITIONS, QUERIES, _committed  # noqa: E402
from alertledger.session import build_session, scratch_dir  # noqa: E402
from alertledger.sources import fixtures as fx  # noqa: E402
from alertledger.sources.store import LayerStore  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))


def log(*a):
    print(*a, file=sys.stderr, flush=True)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def median_of(fn, repeat: int = REPEAT) -> float:
    fn()  # warm-up (plan caches, JIT)
    return statistics.median(timed(fn) for _ in range(repeat))


def main() -> None:
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=max(8, 2 * CPUS), app_name="alertledger-bench")
    sf = os.path.basename(SF_DIR).replace("sf", "")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    # ---- batch chain: one warm-up run into a throwaway store, then the timed run into a fresh one ----
    landing = fx.alerts_from_orders(spark, SF_DIR)
    warm = LayerStore(spark, scratch_dir(spark, "bench-warmup"))
    medallion.bronze_to_silver(landing, warm, now=fx.ntz(fx.SILVER_NOW), parse_partitions=PARSE_PARTITIONS)
    medallion.silver_to_gold(warm)
    store = LayerStore(spark, scratch_dir(spark, "bench"))
    times["e2e_bronze_to_silver"] = timed(
        lambda: medallion.bronze_to_silver(landing, store, now=fx.ntz(fx.SILVER_NOW), parse_partitions=PARSE_PARTITIONS))
    times["e2e_silver_to_gold"] = timed(lambda: medallion.silver_to_gold(store))
    L = medallion.layers(store)
    rows.update({k: v.count() for k, v in L.items()})
    log("layers", rows)

    # ---- serving queries over the committed layers ----
    silver, gold_daily = L["silver"], L["gold_daily"]
    serving = {
        "kpis": lambda: ledger.kpis(L["bronze"], L["silver_clean"], L["silver_quarantine"], silver, fx.AS_OF),
        "daily_credit_debit": lambda: ledger.daily_credit_debit(gold_daily, fx.RANGE_START, fx.RANGE_END),
        "daily_spend": lambda: ledger.daily_spend(silver, fx.AS_OF, fx.WINDOW_DAYS),
        "spend_calendar": lambda: ledger.threshold_summary(
            ledger.spend_calendar(spark, silver, fx.AS_OF, fx.WINDOW_DAYS, 400), 400),
        "top_merchants": lambda: ledger.top_merchants(silver, fx.RANGE_START, fx.RANGE_END, fx.TOP_N),
        "latest_five": lambda: ledger.latest_in_range(silver, fx.RANGE_START, fx.RANGE_END, 5),
        "ledger_page": lambda: ledger.ledger_page(silver, 2, fx.PAGE_SIZE),
        "ledger_keyset": lambda: ledger.ledger_after(silver, "2001-07-01 12:00:00", "msg-5", fx.PAGE_SIZE),
        "quarantine_grid": lambda: ledger.quarantine_grid(L["silver_quarantine"]),
        "quarantine_with_counts": lambda: ops.quarantine_with_counts(L["silver_quarantine"], L["gold_failures"]),
        "gold_recon_recompute": lambda: gold.recon_metrics(L["bronze"], silver, L["silver_quarantine"]),
        "change_feed_apply": lambda: changes.apply_changes(
            silver, changes.change_feed(silver, silver.withColumn(
                "amount", F.when(F.col("id").endswith("2"), F.col("amount") + 1).otherwise(F.col("amount"))
                .cast("decimal(18,2)")), "id"), "id"),
    }
    for name, build in serving.items():
        times[name] = median_of(lambda b=build: run(b()))
        log(name, round(times[name], 3))

    # ---- one more commit of a small batch (the resends) into the full silver, both layouts ----
    resent = (fx.alerts_from_orders(spark, SF_DIR, keep_parts=True).filter(F.col("r") == 1)
              .drop("o_orderkey", "o_custkey", "r", "k"))
    resends = clean_rows(_committed(spark, resent, fx.SILVER_NOW_2))
    for label, buckets in (("upsert_commit_plain", None), ("upsert_commit_bucketed", 16)):
        layout = LayerStore(spark, scratch_dir(spark, f"bench-{label}"))
        medallion.commit_silver(layout, L["silver_clean"], buckets=buckets)
        times[label] = median_of(lambda s=layout, b=buckets: medallion.commit_silver(s, resends, buckets=b))
        log(label, round(times[label], 3))

    # ---- lazy end-to-end queries straight from the driver tables ----
    for name in ("gold_daily", "upsert_newer_wins", "quality_flags", "gold_recon", "ingest_messages",
                 "json_body_append"):
        times[f"lazy_{name}"] = median_of(lambda n=name: run(QUERIES[n](spark, SF_DIR)))
        log(name, round(times[f"lazy_{name}"], 3))

    # ---- streams: all arrivals, once ----
    for name in ("stream_gold_daily", "stream_dedup"):
        times[name] = timed(lambda n=name: run(QUERIES[n](spark, SF_DIR)))
        log(name, round(times[name], 3))

    total = sum(times.values())
    alerts = rows.get("bronze", 0)
    out = {
        "metric": "total_sec",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": sf,
        "cpus": CPUS,
        "alerts": alerts,
        "parse_to_silver_rows_per_sec": round(alerts / times["e2e_bronze_to_silver"], 1),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
