"""Test inputs derived from the driver tables (FIXTURES.md §2–§6).

Everything here is built with DataFrame operations over ``orders``,
``customer``, ``conversations``, ``events`` and ``nation`` so that the work
grows with the scale factor. The matching DuckDB text lives in
``alertledger.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import MONEY

# Ledger query parameters used by the registered queries (FIXTURES §3).
AS_OF = "2001-07-15"
RANGE_START = "2001-04-16"
RANGE_END = "2001-07-15"
WINDOW_DAYS = 30
THRESHOLD = 1_000_000
TOP_N = 7
PAGE_SIZE = 25
FIRST_YEAR = 1995  # of the orders

# Fixed processing stamps so stamped outputs are reproducible.
BRONZE_NOW = "2001-08-02 00:00:00"
SILVER_NOW = "2001-08-02 01:00:00"
SILVER_NOW_2 = "2001-08-03 01:00:00"


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDERS_PER_TASK = 50_000
TEXT_TASKS = 16  # least tasks that build the texts of the alerts


def tasks_for_orders(spark: SparkSession, sf_dir: str, at_least: int, ways: int = 1) -> int:
    """Tasks (or buckets) for one of ``ways`` shares of the orders: ``at_least`` so many, and more as the orders grow.
    The count comes from the footers of the files."""
    return max(at_least, -(-table(spark, sf_dir, "orders").count() // (ORDERS_PER_TASK * ways)))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _mod(c: str, n: int) -> Column:
    return F.col(c) % F.lit(n)


# --------------------------------------------------------------------------- §2
def _alert_parts(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """orders ⋈ customer plus one resend row for every 7th order (r = 1).

    The rows are dealt over ``tasks`` (as many as the orders ask for) while they are numbers: files of orders can be few
    and long, and the texts made of a row cost far more than the row.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    base = orders.join(customer, "o_custkey")
    rows = base.withColumn("r", F.lit(0)).unionByName(
        base.filter(_mod("o_orderkey", 7) == 0).withColumn("r", F.lit(1)))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    local = F.col("o_orderdate") + _hours(ok % 24)
    return rows.select(
        "o_orderkey", "o_custkey", "r",
        (ok % 12).alias("k"),
        (F.col("o_totalprice").cast(MONEY) + F.col("r")).cast(MONEY).alias("amt"),
        F.lpad((ok % 10000).cast("string"), 4, "0").alias("c4"),
        F.concat(F.lit("REF"), ok.cast("string")).alias("ref"),
        F.concat(F.lit("SHOP "), (ck % 40).cast("string")).alias("m"),
        F.concat(F.lit("shop"), (ck % 40).cast("string"), F.lit("@upi")).alias("vpa"),
        F.element_at(F.array(*[F.lit(c) for c in ("PUNE", "DELHI", "MUMBAI", "CHENNAI")]),
                     (ck % 4 + 1).cast("int")).alias("city"),
        local.alias("local"),
        F.abs(F.col("c_acctbal")).cast(MONEY).alias("bal"),
    ).repartition(tasks_for_orders(spark, sf_dir, TEXT_TASKS) if tasks is None else tasks)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _wall_clock(ts: str, short_year: bool = False, with_time: bool = True) -> Column:
    """dd-MM-yyyy HH:mm:ss (or dd-MM-yy) of a zone-less timestamp, without any zone conversion."""
    t = F.col(ts)
    year = _two(F.year(t) % 100) if short_year else F.lpad(F.year(t).cast("string"), 4, "0")
    date = F.concat_ws("-", _two(F.dayofmonth(t)), _two(F.month(t)), year)
    if not with_time:
        return date
    return F.concat(date, F.lit(" "), F.concat_ws(":", _two(F.hour(t)), _two(F.minute(t)), _two(F.second(t))))


def _body(p: DataFrame) -> Column:
    amt = F.format_number(F.col("amt"), 2)
    bal = F.format_number(F.col("bal"), 2)
    dt = _wall_clock("local")
    d8 = _wall_clock("local", short_year=True, with_time=False)
    c4, ref, m, vpa, city = (F.col(c) for c in ("c4", "ref", "m", "vpa", "city"))
    s = F.lit
    templates = [
        F.concat(s("Rs."), amt, s(" has been debited from account "), c4, s(" to VPA "), vpa, s(" "), m,
                 s(" on "), d8, s(". UPI transaction reference number is "), ref),
        F.concat(s("Rs."), amt, s(" credited by VPA "), vpa, s(" "), m, s(" on "), d8, s(" through UPI")),
        F.concat(s("ATM withdrawal for Rs "), amt, s(" in "), city, s(" at BRANCH "), c4, s(" on "), dt,
                 s(". Card ending "), c4, s(". Available balance is Rs "), bal),
        F.concat(s("Rs."), amt, s(" spent with Credit Card **"), c4, s(" at "), m, s(" on "), dt),
        F.concat(s("purchase of Rs "), amt, s(" using Debit Card ** "), c4, s(" at "), m, s(" on "), dt),
        F.concat(s("Rs."), amt, s(" credited via NEFT ref no: "), ref),
        F.concat(s("account debited Rs."), amt, s(" via IMPS ref# "), ref),
        F.concat(s("You have received Rs."), amt, s(" by RTGS reference: "), ref),
        F.concat(s("refund of Rs."), amt, s(" processed")),
        s("USD 12.50 spent abroad"),
        F.concat(s("Rs."), amt, s(" noted")),
        s("Rs.0 debited"),
    ]
    expr = None
    for k, text in enumerate(templates):
        expr = F.when(F.col("k") == k, text) if expr is None else expr.when(F.col("k") == k, text)
    return expr


SENDERS = ["alerts@hdfcbank.example", "alerts@icicibank.example", "alerts@axisbank.example",
           "alerts@sbi.example", "alerts@other.example"]


def alerts_from_orders(spark: SparkSession, sf_dir: str, keep_parts: bool = False, tasks: int | None = None) -> DataFrame:
    """Landing-schema alert messages synthesised from orders (FIXTURES §2), evenly over ``tasks``."""
    p = _alert_parts(spark, sf_dir, tasks)
    ok = F.col("o_orderkey")
    body = F.when(ok % 79 != 11, _body(p))
    event_time = F.when(ok % 83 != 3,
                        F.col("local") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(90))
                        + F.make_dt_interval(F.col("r") * 2))
    sender = F.when(ok % 97 != 5,
                    F.element_at(F.array(*[F.lit(s) for s in SENDERS]), (F.col("o_custkey") % 5 + 1).cast("int")))
    landing = p.select(
        *(["o_orderkey", "o_custkey", "r", "k"] if keep_parts else []),
        F.when(ok % 89 != 7, F.concat(F.lit("msg-"), ok.cast("string"))).alias("id"),
        F.concat(F.lit("thr-"), F.col("o_custkey").cast("string")).alias("thread_id"),
        F.lit("Transaction alert").alias("subject"),
        sender.alias("sender"),
        F.lit("me@example.com").alias("recipient"),
        body.alias("body"),
        event_time.alias("event_time"),
    )
    return landing.select(
        *(["o_orderkey", "o_custkey", "r", "k"] if keep_parts else []),
        "id", "thread_id", "subject", "sender", "recipient", "body",
        F.substring("body", 1, 200).alias("snippet"),
        "event_time",
        F.col("event_time").alias("ingestion_time"),
    )


# --------------------------------------------------------------------------- §3
TXN_TYPE_BY_PRIORITY = {  # fixture choice: order priority → payment type
    "1-URGENT": "UPI", "2-HIGH": "CREDIT_CARD", "3-MEDIUM": "DEBIT_CARD",
    "4-NOT SPECIFIED": "NEFT", "5-LOW": "ATM_WITHDRAWAL",
}
BANKS = ["HDFC", "ICICI", "AXIS", "SBI", "OTHER"]


def _case_map(c: Column, mapping: dict[str, str], default: str) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(c == key, F.lit(value)) if expr is None else expr.when(c == key, F.lit(value))
    return expr.otherwise(F.lit(default))


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver-shaped ledger straight from ``orders`` (no parsing), FIXTURES §3."""
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    m = F.concat(F.lit("SHOP "), (ck % 40).cast("string"))
    event_time = F.col("o_orderdate") + _hours(ok % 24)
    local = F.when(ok % 3 != 0, event_time - _hours(ok % 36))
    ledger = o.select(
        F.concat(F.lit("msg-"), ok.cast("string")).alias("id"),
        F.concat(F.lit("thr-"), ck.cast("string")).alias("thread_id"),
        F.element_at(F.array(*[F.lit(s) for s in SENDERS]), (ck % 5 + 1).cast("int")).alias("sender"),
        F.lit("me@example.com").alias("recipient"),
        F.lit("Transaction alert").alias("subject"),
        F.element_at(F.array(*[F.lit(b) for b in BANKS]), (ck % 5 + 1).cast("int")).alias("bank"),
        _case_map(F.col("o_orderpriority"), TXN_TYPE_BY_PRIORITY, "OTHER").alias("txn_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit("CREDIT")).otherwise(F.lit("DEBIT")).alias("direction"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.lit("INR").alias("currency"),
        F.concat(F.lit("REF"), ok.cast("string")).alias("txn_ref"),
        F.when(ok % 5 != 0, F.concat(F.lit("shop"), (ck % 40).cast("string"), F.lit("@upi"))).alias("vpa"),
        F.when(ok % 11 == 0, F.lit(None).cast("string"))
         .when(ok % 13 == 0, F.lit("")).otherwise(m).alias("counterparty"),
        local.alias("txn_datetime_local"),
        event_time.alias("event_time"),
        event_time.alias("ingestion_time"),
        (event_time + F.make_dt_interval(F.lit(1))).alias("_bronze_ingested_at"),
        (event_time + F.make_dt_interval(F.lit(1))).alias("_silver_processed_at"),
    )
    eff = F.coalesce(F.col("txn_datetime_local"), F.col("event_time"))
    return ledger.withColumn("effective_ts", eff).withColumn("effective_date", F.to_date(eff))


# --------------------------------------------------------------------------- §4
def mail_threads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads, messages, seen) from ``conversations`` (FIXTURES §4).

    The mailbox is kept normalised — one row per thread, one per message — so
    no message list is ever gathered into one row.
    """
    conv = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id")
    threads = conv.select("conv_id").distinct().select(
        cid.cast("string").alias("thread_id"),
        F.when(cid % 3 == 0, F.lit("ALERT")).otherwise(F.lit("OTHER")).alias("label"),
        (cid % 2 == 0).alias("is_unread"),
    )
    messages = conv.select(
        F.concat(cid.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        cid.cast("string").alias("thread_id"),
        "turn",
        F.concat(F.lit("Conversation "), cid.cast("string")).alias("subject"),
        F.col("role").alias("sender"),
        F.lit("me@example.com").alias("recipient"),
        F.col("text").alias("body"),
    )
    seen = messages.filter(F.col("turn") == 0).select("id")
    return threads, messages, seen


# --------------------------------------------------------------------------- §6
RUN_STATES = ["SUCCESS", "FAILED", "RUNNING", "CANCELED"]


def runs_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    nk = F.col("n_nationkey")
    return n.select(
        nk.cast("long").alias("run_id"),
        F.col("n_regionkey").cast("long").alias("job_id"),
        F.to_timestamp_ntz(F.date_sub(F.lit(AS_OF).cast("date"), nk).cast("string")).alias("start_time"),
        F.element_at(F.array(*[F.lit(s) for s in RUN_STATES]), (nk % 4 + 1).cast("int")).alias("state"),
        (nk + 60).cast("long").alias("duration_s"),
    )


def change_pair(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(before, after) versions of the ledger for change-feed tests (FIXTURES §6); ``ledger``: as it is stored, if it is."""
    ledger = ledger_orders(spark, sf_dir) if ledger is None else ledger
    n = F.substring_index(F.col("id"), "-", -1).cast("long") % 10
    before = ledger.filter(n != 0)
    after = ledger.filter(n != 1).withColumn(
        "amount", F.when(n == 2, (F.col("amount") + 1).cast(MONEY)).otherwise(F.col("amount")))
    return before, after
