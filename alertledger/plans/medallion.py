"""End-to-end batch jobs: landing → bronze → parsed → clean/quarantine → silver → gold.

Each step commits a layer in the ``LayerStore`` and the next step reads the
committed layer, so every hop is a lineage cut and a lost executor only costs a
task retry. The parse runs exactly once: the flagged rows are written a single
time, partitioned by ``_dq`` (``clean`` / ``quarantine``), and the two layers
are the two partition folders — no second scan, no second evaluation of the
regexes.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators import gold
from ..operators.parse import DQ, clean_rows, flagged, parse_alerts, quarantine_rows
from ..operators.upsert import to_silver, upsert, upsert_bucketed
from ..schemas import BRONZE, SILVER
from ..sources.ingest import to_bronze
from ..sources.store import LayerStore

# Silver files come out hash-partitioned by id (the upsert's shuffle), so every
# file spans every date. Sorting rows by effective date inside each file gives
# the parquet row groups tight min/max statistics: the ledger's pushed-down
# date-range predicates then skip most row groups of every file. A local sort,
# no extra shuffle.
SILVER_SORT = ["effective_date", "effective_ts"]


def commit_silver(store: LayerStore, clean: DataFrame, tag: str | None = None,
                  buckets: int | None = None) -> int:
    """J2 + commit: merge clean rows into the current silver and write the next version.

    With ``buckets`` silver is kept as a Spark bucketed table on ``id``: each
    commit then shuffles only the incoming rows (the stored side is read
    already partitioned), which is what keeps per-batch cost proportional to
    the batch rather than to the table.
    """
    target, stored_buckets = silver_target(store, buckets)
    if buckets is None:
        return store.write(upsert(target, to_silver(clean)), "silver", tag=tag, sort_within=SILVER_SORT)
    if stored_buckets is not None:
        merged = upsert_bucketed(target, clean, buckets)
    elif target is not None:  # plain silver so far: this commit moves it into buckets
        merged = upsert(target, to_silver(clean)).repartition(buckets, "id")
    else:
        # hash into the bucket layout first: the window reuses it and each task writes one bucket file
        merged = upsert(None, to_silver(clean).repartition(buckets, "id"))
    return store.write_bucketed(merged, "silver", "id", buckets, tag=tag, sort_within=SILVER_SORT)


def silver_target(store: LayerStore, buckets: int | None) -> tuple[DataFrame | None, int | None]:
    """The committed silver, if any, and its buckets if it can be read by them."""
    if not store.exists("silver"):
        return None, None
    if buckets is None or not store.is_bucketed("silver"):
        return store.read("silver", schema=SILVER), None
    return store.read_bucketed("silver", "id", buckets), buckets


def bronze_to_silver(landing: DataFrame, store: LayerStore, source: str = "landing",
                     now: Column | None = None, tag: str | None = None,
                     silver_buckets: int | None = None, parse_partitions: int | None = None) -> dict[str, int]:
    """E1 for one batch of landing rows; returns the committed version numbers.

    ``parse_partitions``: tasks that the raw rows are dealt over for the parse (see ``parse_alerts``).
    """
    out = {"bronze": store.write(to_bronze(landing, source, now), "bronze", tag=tag)}
    parsed = flagged(parse_alerts(store.read("bronze", schema=BRONZE), now, parse_partitions))
    out["parsed"] = store.write(parsed, "parsed", tag=tag, partition_by=[DQ])
    clean = clean_rows(store.read("parsed", schema=parsed.schema))
    out["silver"] = commit_silver(store, clean, tag=tag, buckets=silver_buckets)
    return out


def parsed_schema(store: LayerStore) -> StructType:
    """Schema of the flagged parsed layer (nothing is run for it)."""
    return flagged(parse_alerts(store.spark.createDataFrame([], BRONZE), F.lit(None).cast("timestamp_ntz"))).schema


def silver_to_gold(store: LayerStore, landing: DataFrame | None = None,
                   tag: str | None = None, parallel: bool = True) -> dict[str, int]:
    """The four gold tables from the committed silver / quarantine / landing.

    The four writes are independent jobs; with ``parallel`` they are submitted
    together from a small thread pool so the scheduler can run their tasks
    side by side (each is small next to the cluster at gold sizes).
    """
    silver = store.read("silver", schema=SILVER)
    quarantine = quarantine_rows(store.read("parsed", schema=parsed_schema(store)))
    landing = store.read("bronze", schema=BRONZE) if landing is None else landing
    jobs = {
        "gold_daily": lambda: store.write(gold.daily_summary(silver), "gold_daily", tag=tag),
        "gold_merchant": lambda: store.write(gold.merchant_summary(silver), "gold_merchant", tag=tag),
        # The reference sorts these two before writing; a sort inside each
        # file keeps that locality without a global range shuffle.
        "gold_recon": lambda: store.write(gold.recon_metrics(landing, silver, quarantine), "gold_recon", tag=tag,
                                          sort_within=[F.col("txn_date").desc()]),
        "gold_failures": lambda: store.write(gold.failure_reason_counts(quarantine), "gold_failures", tag=tag,
                                             sort_within=[F.col("txn_date").desc(),
                                                          F.col("failure_count").desc()]),
    }
    if not parallel:
        return {name: job() for name, job in jobs.items()}
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def layers(store: LayerStore) -> dict[str, DataFrame]:
    """The committed layers by their reference names (for KPIs and counts)."""
    parsed = store.read("parsed", schema=parsed_schema(store))
    out = {
        "bronze": store.read("bronze", schema=BRONZE),
        "silver_clean": clean_rows(parsed),
        "silver_quarantine": quarantine_rows(parsed),
        "silver": store.read("silver", schema=SILVER),
    }
    for name in ("gold_daily", "gold_merchant", "gold_recon", "gold_failures"):
        if store.exists(name):
            out[name] = store.read(name)
    return out
