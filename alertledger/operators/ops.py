"""Operations views: layer inventory (S10), runs ⟕ recon (S11, J5), quarantine rows
with their reasons' daily counts (J6).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..schemas import RUNS

RECON_COLUMNS = ["txn_date", "ingested_count", "processed_count", "failed_count",
                 "duplicates_dropped", "pass_rate_pct"]


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, row_count) for every layer; each count is a partial+final global agg."""
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("layer"), "row_count")
              for name, df in layers.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def runs_with_recon(runs: DataFrame | None, recon: DataFrame, job_ids: Iterable[int] | None = None,
                    latest: int | None = None) -> DataFrame:
    """Each pipeline run next to the recon row of its run date.

    ``runs`` is whatever run history the caller could read (S11). When none is
    readable (``None``) the view falls back to recon alone with empty run
    columns, as the operations page does. ``latest`` keeps the newest runs.
    """
    if runs is None:
        return recon.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in RUNS.fields],
                            *RECON_COLUMNS)
    r = runs
    if job_ids is not None:
        r = r.filter(F.col("job_id").isin(list(job_ids)))
    if latest is not None:
        r = r.orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(latest)
    r = r.withColumn("_run_date", F.to_date("start_time"))
    joined = r.join(recon, r["_run_date"] == recon["txn_date"], "left")
    return joined.select(*[r[f.name] for f in RUNS.fields], *[recon[c] for c in RECON_COLUMNS])


def quarantine_with_counts(quarantine: DataFrame, gold_failures: DataFrame) -> DataFrame:
    """Every quarantined row with, per reason, that reason's count on its date.

    Gold failures hold at most one row per (date, reason) and reasons form a
    fixed set of six, so a per-date map is small and bounded; the quarantine
    side is never exploded or regrouped (a NULL or hot id cannot pile up in
    one task). The per-date side has one row per date; Spark broadcasts it
    only when its measured size is under the broadcast threshold.
    """
    per_date = (gold_failures
                .groupBy("txn_date")
                .agg(F.map_from_entries(F.collect_list(F.struct("reason", "failure_count"))).alias("_counts")))
    q = quarantine.withColumn("_qdate", F.to_date("event_time"))
    joined = q.join(per_date, q["_qdate"].eqNullSafe(per_date["txn_date"]), "left")
    counts = F.transform("failure_reasons",
                         lambda r: F.struct(r.alias("reason"),
                                            F.coalesce(F.element_at(F.col("_counts"), r), F.lit(0).cast("long"))
                                            .alias("failure_count")))
    return joined.select(q["id"], q["event_time"], q["_qdate"].alias("txn_date"), q["sender"],
                         q["amount"], q["direction"], q["failure_reasons"],
                         counts.alias("reason_counts"))
