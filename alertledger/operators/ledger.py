"""Parameterised ledger questions.

Parameters are column literals, never spliced SQL. "Today" is an ``as_of``
date (default ``current_date()``). Two date bases are kept apart: the
*arrival* date ``to_date(event_time)`` and the *effective* date
``to_date(coalesce(txn_datetime_local, event_time))``, which silver
materialises as ``effective_date`` so range filters on it are plain column
predicates that reach the parquet scan.

Scale notes: KPI rows are one global aggregate over a union of narrow
projections (each table scanned once, partial aggregation in every task, no
joins); the spend calendar is a union with a parameter-sized day spine, not a
join; every top-k is Spark's ``TakeOrderedAndProject`` (per-task top-k, then a
merge of k × tasks rows) with a total tie-break so results are reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import effective_ts, reasons_text

_SRC = "_src"


def _date(d: str | _dt.date | Column | None) -> Column:
    if d is None:
        return F.current_date()
    if isinstance(d, Column):
        return d
    return F.lit(str(d)).cast("date")


def with_effective(df: DataFrame) -> DataFrame:
    if "effective_ts" in df.columns and "effective_date" in df.columns:
        return df
    eff = effective_ts()
    return df.withColumn("effective_ts", eff).withColumn("effective_date", F.to_date(eff))


# ----------------------------------------------------------------- filters
def in_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """Inclusive date range on ``column``."""
    return df.filter(F.col(column).between(_date(start), _date(end)))


def trailing_window(df: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Effective date ≥ as_of − days; deliberately no upper bound."""
    return with_effective(df).filter(F.col("effective_date") >= F.date_sub(_date(as_of), days))


# ----------------------------------------------------------------- KPIs
def kpis(bronze: DataFrame, clean: DataFrame, quarantine: DataFrame, silver: DataFrame,
         as_of=None) -> DataFrame:
    """All-time and as-of-day KPI row in one pass per table.

    Counts use the arrival date; money uses the effective date (X10).
    """
    day = _date(as_of)
    arrival = F.to_date("event_time").alias("arrival_date")
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("date")
    none_m = F.lit(None).cast("decimal(18,2)")

    def counted(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.lit(tag).alias(_SRC), arrival, none_d.alias("effective_date"),
                         none_s.alias("direction"), none_m.alias("amount"))

    s = with_effective(silver)
    money = s.select(F.lit(3).alias(_SRC), none_d.alias("arrival_date"), "effective_date", "direction",
                     F.col("amount").cast("decimal(18,2)").alias("amount"))
    u = counted(bronze, 0).unionByName(counted(clean, 1)).unionByName(counted(quarantine, 2)).unionByName(money)
    src, on_day, eff_day = F.col(_SRC), F.col("arrival_date") == day, F.col("effective_date") == day

    def money_sum(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0).cast("decimal(28,2)"))

    credit, debit = F.col("direction") == "CREDIT", F.col("direction") == "DEBIT"
    return u.agg(
        F.count_if(src == 0).alias("bronze_total"),
        F.count_if(src == 1).alias("silver_clean_total"),
        F.count_if(src == 2).alias("quarantine_total"),
        money_sum((src == 3) & credit).alias("credit_total"),
        money_sum((src == 3) & debit).alias("debit_total"),
        F.count_if((src == 0) & on_day).alias("bronze_today"),
        F.count_if((src == 1) & on_day).alias("clean_today"),
        F.count_if((src == 2) & on_day).alias("q_today"),
        money_sum((src == 3) & credit & eff_day).alias("credit_today"),
        money_sum((src == 3) & debit & eff_day).alias("debit_today"),
    )


def failure_kpis(kpi: DataFrame) -> DataFrame:
    """The reference's failure figure plus its two honest parts."""
    def parts(total, clean, quar):
        b, c, q = F.col(total), F.col(clean), F.col(quar)
        return (b - c + q), q, (b - c - q)
    f_all, q_all, d_all = parts("bronze_total", "silver_clean_total", "quarantine_total")
    f_day, q_day, d_day = parts("bronze_today", "clean_today", "q_today")
    return kpi.select(
        F.col("bronze_total").alias("ingestion_total"), f_all.alias("failure_total"),
        q_all.alias("quarantine_total"), d_all.alias("dropout_total"),
        F.col("bronze_today").alias("ingestion_today"), f_day.alias("failure_today"),
        q_day.alias("quarantine_today"), d_day.alias("dropout_today"))


# ----------------------------------------------------------------- daily charts
def daily_credit_debit(gold_daily: DataFrame, start, end) -> DataFrame:
    """Re-sum gold daily over bank / type / currency."""
    return (in_range(gold_daily, "txn_date", start, end)
            .groupBy("txn_date", "direction")
            .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("decimal(38,2)").alias("amount")))


def directions_present(gold_daily: DataFrame, start, end) -> DataFrame:
    """A10: which directions occur in range — BOTH / DEBIT_ONLY / CREDIT_ONLY / NONE."""
    r = in_range(gold_daily, "txn_date", start, end)
    row = r.agg(F.coalesce(F.bool_or(F.col("direction") == "DEBIT"), F.lit(False)).alias("has_debit"),
                F.coalesce(F.bool_or(F.col("direction") == "CREDIT"), F.lit(False)).alias("has_credit"))
    d, c = F.col("has_debit"), F.col("has_credit")
    return row.withColumn("directions", F.when(d & c, "BOTH").when(d, "DEBIT_ONLY")
                          .when(c, "CREDIT_ONLY").otherwise("NONE"))


def daily_spend(silver: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """A11 + W7: DEBIT by effective date from as_of − days on (future days included)."""
    return (trailing_window(silver, as_of, days)
            .filter(F.col("direction") == "DEBIT")
            .groupBy(F.col("effective_date").alias("day"))
            .agg(F.sum("amount").alias("daily_debit"), F.count(F.lit(1)).alias("txn_count")))


def spend_calendar(spark: SparkSession, silver: DataFrame, as_of=None, days: int = 30,
                   threshold: float = 400) -> DataFrame:
    """One row per day as_of − days … as_of (days + 1 rows), missing days = 0.

    The spine is a parameter-sized sequence; it is unioned with the debit rows
    and summed, so no join is needed and rows after ``as_of`` drop out here.
    """
    day = _date(as_of)
    lo = F.date_sub(day, days)
    spine = spark.range(1).select(F.explode(F.sequence(lo, day)).alias("day"),
                                  F.lit(None).cast("decimal(18,2)").alias("amount"),
                                  F.lit(0).alias("_real"))
    debits = (with_effective(silver)
              .filter((F.col("direction") == "DEBIT") & F.col("effective_date").between(lo, day))
              .select(F.col("effective_date").alias("day"),
                      F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit(1).alias("_real")))
    per_day = (spine.unionByName(debits).groupBy("day")
               .agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("daily_debit"),
                    F.count_if(F.col("_real") == 1).alias("txn_count")))
    limit = F.lit(threshold).cast("decimal(28,2)")
    over = F.col("daily_debit") > limit
    return per_day.select("day", "daily_debit", "txn_count", over.alias("over_threshold"),
                          F.when(over, F.col("daily_debit") - limit).otherwise(F.lit(0))
                          .cast("decimal(28,2)").alias("excess"))


def threshold_summary(calendar: DataFrame, threshold: float = 400) -> DataFrame:
    """Days over (>) and under (≤) the threshold, and the window total."""
    limit = F.lit(threshold).cast("decimal(28,2)")
    return calendar.agg(
        F.count_if(F.col("daily_debit") > limit).alias("days_over"),
        F.count_if(F.col("daily_debit") <= limit).alias("days_under"),
        F.coalesce(F.sum("daily_debit"), F.lit(0)).cast("decimal(38,2)").alias("window_total"),
        F.coalesce(F.max("excess"), F.lit(0)).cast("decimal(28,2)").alias("max_excess"))


def top_merchants(silver: DataFrame, start, end, n: int = 7) -> DataFrame:
    """A13 + L3: DEBIT totals by counterparty (W1b, W5), top n, name as tie-break."""
    rows = (in_range(with_effective(silver), "effective_date", start, end)
            .filter(F.col("counterparty").isNotNull() & (F.col("direction") == "DEBIT")))
    return (rows.groupBy("counterparty")
            .agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("txn_count"))
            .orderBy(F.col("total_amount").desc(), F.col("counterparty").asc())
            .limit(n))


# ----------------------------------------------------------------- latest / paging
def newest_first(df: DataFrame) -> list[Column]:
    return [F.col("effective_ts").desc_nulls_last(), F.col("id").desc_nulls_last()]


def latest_one(silver: DataFrame) -> DataFrame:
    """L1: newest transaction with display labels."""
    s = with_effective(silver)
    top = s.orderBy(*newest_first(s)).limit(1)
    d = F.upper(F.coalesce(F.col("direction"), F.lit("")))
    merchant = F.coalesce(F.nullif(F.col("counterparty"), F.lit("")), F.nullif(F.col("vpa"), F.lit("")),
                          F.lit("—"))
    return top.select(
        F.col("effective_ts").alias("txn_ts"), "amount", "bank", "txn_type", "direction",
        "counterparty", "vpa",
        F.when(d == "DEBIT", "DEBITED").when(d == "CREDIT", "CREDITED").otherwise(d).alias("dir_word"),
        merchant.alias("merchant"))


# Display names of the ledger and quarantine grids.
LEDGER_VIEW = [("effective_ts", "When"), ("bank", "Bank"), ("txn_type", "Type"), ("direction", "Dir"),
               ("amount", "Amount"), ("currency", "Ccy"), ("counterparty", "Counterparty"),
               ("vpa", "VPA"), ("txn_ref", "Ref")]


def latest_in_range(silver: DataFrame, start, end, n: int = 5) -> DataFrame:
    """L2: newest n in the effective-date range, display column names."""
    s = in_range(with_effective(silver), "effective_date", start, end)
    return s.orderBy(*newest_first(s)).limit(n).select(*[F.col(a).alias(b) for a, b in LEDGER_VIEW])


LEDGER_COLUMNS = ["effective_ts", "id", "bank", "txn_type", "direction", "amount", "currency",
                  "counterparty", "vpa", "txn_ref"]


def by_id(silver: DataFrame, ids: list[str]) -> DataFrame:
    """Point lookup: the ledger rows of the given transaction ids (pushed to the scan)."""
    return with_effective(silver).filter(F.col("id").isin(list(ids))).select(*LEDGER_COLUMNS)


def ledger_page(silver: DataFrame, page: int = 0, size: int = 25) -> DataFrame:
    """Page ``page`` (0-based) of the full ledger, newest first."""
    s = with_effective(silver)
    return s.select(*LEDGER_COLUMNS).orderBy(*newest_first(s)).offset(page * size).limit(size)


def ledger_after(silver: DataFrame, cursor_ts, cursor_id: str, size: int = 25) -> DataFrame:
    """L6 keyset paging: the ``size`` rows after cursor (effective_ts, id), newest first.

    Cost does not grow with page depth: a filter plus a per-task top-k.
    """
    s = with_effective(silver)
    ts = F.lit(str(cursor_ts)).cast("timestamp_ntz") if not isinstance(cursor_ts, Column) else cursor_ts
    after = (F.col("effective_ts") < ts) | ((F.col("effective_ts") == ts) & (F.col("id") < F.lit(cursor_id)))
    return s.filter(after).select(*LEDGER_COLUMNS).orderBy(*newest_first(s)).limit(size)


# ----------------------------------------------------------------- quarantine views
def quarantine_grid(quarantine: DataFrame, as_of=None, today_only: bool = False,
                    limit: int = 500) -> DataFrame:
    """L4 (+W8): newest quarantined rows by processing time, display names."""
    q = quarantine
    if today_only:
        q = q.filter(F.to_date("_silver_processed_at") == _date(as_of))
    view = q.select(F.col("_silver_processed_at").alias("When"), F.col("id").alias("ID"),
                    F.col("sender").alias("Sender"), F.col("subject").alias("Subject"),
                    reasons_text().alias("Reasons"), F.col("amount").alias("Amount"),
                    F.col("direction").alias("Dir"), F.col("txn_type").alias("Type"),
                    F.col("event_time").alias("_et"))
    order = [F.col("When").desc_nulls_last(), F.col("ID").desc_nulls_last(), F.col("_et").desc_nulls_last(),
             F.col("Amount").desc_nulls_last(), F.col("Reasons").asc(), F.col("Sender").asc_nulls_last(),
             F.col("Dir").asc(), F.col("Type").asc()]
    return view.orderBy(*order).limit(limit).drop("_et")


def failure_list(gold_failures: DataFrame, as_of=None, today_only: bool = False) -> DataFrame:
    """L5 (+W8): reasons by date desc, count desc."""
    g = gold_failures
    if today_only:
        g = g.filter(F.col("txn_date") == _date(as_of))
    return (g.select(F.col("txn_date").alias("Date"), F.col("reason").alias("Reason"),
                     F.col("failure_count").alias("Count"))
            .orderBy(F.col("Date").desc_nulls_last(), F.col("Count").desc(), F.col("Reason")))


# ----------------------------------------------------------------- previews
def recent_daily(gold_daily: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` gold daily rows (date desc, then the group columns)."""
    return gold_daily.orderBy(F.col("txn_date").desc_nulls_last(), "bank", "txn_type", "direction",
                              "currency").limit(n)


def top_merchant_rows(gold_merchant: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest merchant summary rows by total, with a total tie-break."""
    return gold_merchant.orderBy(F.col("total_amount").desc_nulls_last(), "counterparty",
                                 F.col("vpa").asc_nulls_first(), "txn_type", "direction", "currency").limit(n)
