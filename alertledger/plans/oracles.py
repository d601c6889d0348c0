"""DuckDB oracles: for each registered query, SQL computing the expected result.

Independent of the Spark code path: the fixture frames are rebuilt in SQL, and
the *expected parse* of every synthesised alert is read off the structured
columns it was made from (round-trip oracle) — no regex anywhere. Type casts
pin both engines to the same result types (DuckDB widens decimal sums to
(38,2) and returns DOUBLE for decimal averages; the average here is computed
exactly in integer cents and rounded half-up to 6 places like Spark).
"""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.ledger import LEDGER_COLUMNS
from ..sources import fixtures as fx
from .registry import DEEP_PAGE, LOOKUP_IDS, TRAPS

BRONZE_NOW = f"TIMESTAMP '{fx.BRONZE_NOW}'"
SILVER_NOW = f"TIMESTAMP '{fx.SILVER_NOW}'"
SILVER_NOW_2 = f"TIMESTAMP '{fx.SILVER_NOW_2}'"
AS_OF = f"DATE '{fx.AS_OF}'"
START = f"DATE '{fx.RANGE_START}'"
END = f"DATE '{fx.RANGE_END}'"


def avg_money(col: str, scale: int = 6) -> str:
    """Exact AVG(decimal(18,2)) rounded half-up to ``scale`` places (positive values)."""
    cents = f"SUM(CAST({col} * 100 AS HUGEINT))"
    num = f"{cents} * {10 ** (scale - 2)}"
    rounded = f"(2 * {num} + COUNT({col})) // (2 * COUNT({col}))"
    return (f"CAST(CAST({rounded} AS DECIMAL(38,0)) * CAST(0.{'0' * (scale - 1)}1 AS DECIMAL(18,{scale}))"
            f" AS DECIMAL(22,{scale}))")


# --------------------------------------------------------------------------- §2 alerts
_A = "format('{:,.2f}', f_amt)"
_B = "format('{:,.2f}', f_bal)"
_DT = "strftime(f_local, '%d-%m-%Y %H:%M:%S')"
_D8 = "strftime(f_local, '%d-%m-%y')"

ALERTS = f"""
parts AS (
  SELECT o.o_orderkey AS okey, o.o_custkey AS ckey, 0 AS r, o.o_totalprice AS price,
         o.o_orderdate AS odate, c.c_acctbal AS acctbal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL
  SELECT o.o_orderkey, o.o_custkey, 1, o.o_totalprice, o.o_orderdate, c.c_acctbal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderkey % 7 = 0
),
p AS (
  SELECT okey, ckey, r, okey % 12 AS k,
    CAST(CAST(price AS DECIMAL(18,2)) + r AS DECIMAL(18,2)) AS f_amt,
    lpad(CAST(okey % 10000 AS VARCHAR), 4, '0') AS f_c4,
    'REF' || okey AS f_ref,
    'SHOP ' || (ckey % 40) AS f_m,
    'shop' || (ckey % 40) || '@upi' AS f_vpa,
    CASE ckey % 4 WHEN 0 THEN 'PUNE' WHEN 1 THEN 'DELHI' WHEN 2 THEN 'MUMBAI' ELSE 'CHENNAI' END AS f_city,
    odate + to_hours(CAST(okey % 24 AS BIGINT)) AS f_local,
    CAST(abs(acctbal) AS DECIMAL(18,2)) AS f_bal
  FROM parts
),
alerts AS (
  SELECT p.*,
    CASE WHEN okey % 89 = 7 THEN NULL ELSE 'msg-' || okey END AS id,
    'thr-' || ckey AS thread_id,
    'Transaction alert' AS subject,
    CASE WHEN okey % 97 = 5 THEN NULL ELSE CASE ckey % 5
      WHEN 0 THEN 'alerts@hdfcbank.example' WHEN 1 THEN 'alerts@icicibank.example'
      WHEN 2 THEN 'alerts@axisbank.example' WHEN 3 THEN 'alerts@sbi.example'
      ELSE 'alerts@other.example' END END AS sender,
    'me@example.com' AS recipient,
    CASE WHEN okey % 79 = 11 THEN NULL ELSE CASE k
      WHEN 0 THEN 'Rs.' || {_A} || ' has been debited from account ' || f_c4 || ' to VPA ' || f_vpa || ' '
                  || f_m || ' on ' || {_D8} || '. UPI transaction reference number is ' || f_ref
      WHEN 1 THEN 'Rs.' || {_A} || ' credited by VPA ' || f_vpa || ' ' || f_m || ' on ' || {_D8} || ' through UPI'
      WHEN 2 THEN 'ATM withdrawal for Rs ' || {_A} || ' in ' || f_city || ' at BRANCH ' || f_c4 || ' on ' || {_DT}
                  || '. Card ending ' || f_c4 || '. Available balance is Rs ' || {_B}
      WHEN 3 THEN 'Rs.' || {_A} || ' spent with Credit Card **' || f_c4 || ' at ' || f_m || ' on ' || {_DT}
      WHEN 4 THEN 'purchase of Rs ' || {_A} || ' using Debit Card ** ' || f_c4 || ' at ' || f_m || ' on ' || {_DT}
      WHEN 5 THEN 'Rs.' || {_A} || ' credited via NEFT ref no: ' || f_ref
      WHEN 6 THEN 'account debited Rs.' || {_A} || ' via IMPS ref# ' || f_ref
      WHEN 7 THEN 'You have received Rs.' || {_A} || ' by RTGS reference: ' || f_ref
      WHEN 8 THEN 'refund of Rs.' || {_A} || ' processed'
      WHEN 9 THEN 'USD 12.50 spent abroad'
      WHEN 10 THEN 'Rs.' || {_A} || ' noted'
      ELSE 'Rs.0 debited' END END AS body,
    CASE WHEN okey % 83 = 3 THEN NULL
         ELSE f_local + INTERVAL 90 MINUTE + to_days(CAST(2 * r AS INTEGER)) END AS event_time
  FROM p
),
landing AS (
  SELECT *, substr(body, 1, 200) AS snippet, event_time AS ingestion_time FROM alerts
),
xp AS (
  SELECT l.*,
    CASE WHEN sender IS NULL THEN 'OTHER' ELSE CASE ckey % 5 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'ICICI'
      WHEN 2 THEN 'AXIS' WHEN 3 THEN 'SBI' ELSE 'OTHER' END END AS bank,
    CASE WHEN body IS NULL THEN 'OTHER' WHEN k IN (0, 1) THEN 'UPI' WHEN k = 2 THEN 'ATM_WITHDRAWAL'
      WHEN k = 3 THEN 'CREDIT_CARD' WHEN k = 4 THEN 'DEBIT_CARD' WHEN k = 5 THEN 'NEFT' WHEN k = 6 THEN 'IMPS'
      WHEN k = 7 THEN 'RTGS' ELSE 'OTHER' END AS txn_type,
    CASE WHEN body IS NULL OR k = 10 THEN 'UNKNOWN' WHEN k IN (1, 5, 7, 8) THEN 'CREDIT' ELSE 'DEBIT' END
      AS direction,
    CASE WHEN body IS NULL OR k = 9 THEN NULL WHEN k = 11 THEN CAST(0 AS DECIMAL(18,2)) ELSE f_amt END AS amount,
    CASE WHEN body IS NULL THEN 'UNKNOWN' WHEN k = 9 THEN 'USD' ELSE 'INR' END AS currency,
    CASE WHEN body IS NOT NULL AND k IN (0, 5, 6, 7) THEN f_ref END AS txn_ref,
    CASE WHEN body IS NOT NULL AND k IN (0, 1) THEN f_vpa END AS vpa,
    CASE WHEN body IS NOT NULL AND k IN (0, 1) THEN f_m END AS counterparty,
    CASE WHEN body IS NOT NULL AND k IN (2, 3, 4) THEN f_c4 END AS card_last4,
    CASE WHEN body IS NOT NULL AND k = 0 THEN f_c4 END AS account_last4,
    CASE WHEN body IS NOT NULL AND k = 2 THEN f_city END AS location_city,
    CASE WHEN body IS NOT NULL AND k = 2 THEN 'BRANCH ' || f_c4
         WHEN body IS NOT NULL AND k IN (3, 4) THEN f_m END AS location_place,
    CASE WHEN body IS NOT NULL AND k = 2 THEN f_bal END AS available_balance,
    CASE WHEN body IS NOT NULL AND k IN (2, 3, 4) THEN f_local END AS txn_datetime_local
  FROM landing l
),
xf AS (
  SELECT *,
    concat_ws(',',
      CASE WHEN id IS NULL THEN 'mandatory_field_missing:id' END,
      CASE WHEN sender IS NULL THEN 'mandatory_field_missing:sender' END,
      CASE WHEN event_time IS NULL THEN 'mandatory_field_missing:event_time' END,
      CASE WHEN body IS NULL AND snippet IS NULL THEN 'mandatory_field_missing:body_and_snippet' END,
      CASE WHEN amount IS NULL OR amount <= 0 THEN 'invalid_amount' END,
      CASE WHEN direction NOT IN ('DEBIT', 'CREDIT') THEN 'invalid_direction' END) AS reasons,
    CAST((CASE WHEN id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN sender IS NULL THEN 1 ELSE 0 END)
      + (CASE WHEN event_time IS NULL THEN 1 ELSE 0 END) + (CASE WHEN body IS NULL THEN 1 ELSE 0 END)
      + (CASE WHEN amount IS NULL OR amount <= 0 THEN 1 ELSE 0 END)
      + (CASE WHEN direction NOT IN ('DEBIT', 'CREDIT') THEN 1 ELSE 0 END) AS INTEGER) AS n_reasons
  FROM xp
),
xclean AS (SELECT * FROM xf WHERE reasons = ''),
xquar AS (SELECT * FROM xf WHERE reasons <> ''),
xs AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_time DESC) AS rn FROM xclean) t
  WHERE rn = 1
)"""

PARSED_VIEW = ("id, thread_id, sender, recipient, subject, bank, txn_type, direction, amount, currency, txn_ref, "
               "vpa, counterparty, card_last4, account_last4, location_city, location_place, "
               "available_balance, txn_datetime_local, event_time, ingestion_time")


def silver_select(src: str, stamp: str) -> str:
    return (f"SELECT id, thread_id, sender, recipient, subject, bank, txn_type, direction, amount, currency, "
            f"txn_ref, vpa, counterparty, card_last4, account_last4, location_city, location_place, "
            f"available_balance, txn_datetime_local, event_time, ingestion_time, "
            f"{BRONZE_NOW} AS _bronze_ingested_at, {stamp} AS _silver_processed_at, "
            f"COALESCE(txn_datetime_local, event_time) AS effective_ts, "
            f"CAST(COALESCE(txn_datetime_local, event_time) AS DATE) AS effective_date FROM {src}")


def with_alerts(body: str) -> str:
    return f"WITH {ALERTS}\n{body}"


# --------------------------------------------------------------------------- §3 ledger
LEDGER = """
lg0 AS (
  SELECT 'msg-' || o_orderkey AS id,
    'thr-' || o_custkey AS thread_id,
    CASE o_custkey % 5 WHEN 0 THEN 'alerts@hdfcbank.example' WHEN 1 THEN 'alerts@icicibank.example'
      WHEN 2 THEN 'alerts@axisbank.example' WHEN 3 THEN 'alerts@sbi.example' ELSE 'alerts@other.example' END
      AS sender,
    CASE o_custkey % 5 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'ICICI' WHEN 2 THEN 'AXIS' WHEN 3 THEN 'SBI'
      ELSE 'OTHER' END AS bank,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'UPI' WHEN '2-HIGH' THEN 'CREDIT_CARD'
      WHEN '3-MEDIUM' THEN 'DEBIT_CARD' WHEN '4-NOT SPECIFIED' THEN 'NEFT' WHEN '5-LOW' THEN 'ATM_WITHDRAWAL'
      ELSE 'OTHER' END AS txn_type,
    CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    'INR' AS currency,
    'REF' || o_orderkey AS txn_ref,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'shop' || (o_custkey % 40) || '@upi' END AS vpa,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ''
      ELSE 'SHOP ' || (o_custkey % 40) END AS counterparty,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS event_time,
    o_orderkey AS okey
  FROM orders
),
lg AS (
  SELECT *,
    CASE WHEN okey % 3 = 0 THEN NULL ELSE event_time - to_hours(CAST(okey % 36 AS BIGINT)) END
      AS txn_datetime_local
  FROM lg0
),
ledger AS (
  SELECT *, COALESCE(txn_datetime_local, event_time) AS effective_ts,
    CAST(COALESCE(txn_datetime_local, event_time) AS DATE) AS effective_date
  FROM lg
),
lgold AS (
  SELECT CAST(event_time AS DATE) AS txn_date, bank, txn_type, direction, currency,
    SUM(amount) AS total_amount
  FROM ledger GROUP BY 1, 2, 3, 4, 5
)"""


def with_ledger(body: str) -> str:
    return f"WITH {LEDGER}\n{body}"


# --------------------------------------------------------------------------- gold over alerts
GOLD_DAILY = f"""
SELECT CAST(event_time AS DATE) AS txn_date, bank, txn_type, direction, currency,
  COUNT(*) AS txn_count,
  CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount,
  {avg_money('amount')} AS avg_amount,
  MIN(amount) AS min_amount, MAX(amount) AS max_amount
FROM xs GROUP BY 1, 2, 3, 4, 5"""

RECON = """
ing AS (SELECT CAST(event_time AS DATE) AS d, COUNT(*) AS n FROM landing GROUP BY 1),
pro AS (SELECT CAST(event_time AS DATE) AS d, COUNT(*) AS n FROM xs GROUP BY 1),
fai AS (SELECT CAST(event_time AS DATE) AS d, COUNT(*) AS n FROM xquar GROUP BY 1),
recon AS (
  SELECT i.d AS txn_date, i.n AS ingested_count, COALESCE(p.n, 0) AS processed_count,
    COALESCE(f.n, 0) AS failed_count,
    GREATEST(i.n - COALESCE(p.n, 0) - COALESCE(f.n, 0), 0) AS duplicates_dropped,
    ROUND(CAST(100.0 AS DOUBLE) * COALESCE(p.n, 0) / CASE WHEN i.n = 0 THEN 1 ELSE i.n END, 2) AS pass_rate_pct
  FROM ing i LEFT JOIN pro p ON i.d = p.d LEFT JOIN fai f ON i.d = f.d
)"""

FAILURES = """
gfail AS (
  SELECT CAST(event_time AS DATE) AS txn_date, reason, COUNT(*) AS failure_count
  FROM (SELECT event_time, unnest(string_split(reasons, ',')) AS reason FROM xquar) t
  GROUP BY 1, 2
)"""

KPIS = f"""
kpi AS (
  SELECT
    (SELECT COUNT(*) FROM landing) AS bronze_total,
    (SELECT COUNT(*) FROM xclean) AS silver_clean_total,
    (SELECT COUNT(*) FROM xquar) AS quarantine_total,
    (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(28,2)) FROM xs WHERE direction = 'CREDIT') AS credit_total,
    (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(28,2)) FROM xs WHERE direction = 'DEBIT') AS debit_total,
    (SELECT COUNT(*) FROM landing WHERE CAST(event_time AS DATE) = {AS_OF}) AS bronze_today,
    (SELECT COUNT(*) FROM xclean WHERE CAST(event_time AS DATE) = {AS_OF}) AS clean_today,
    (SELECT COUNT(*) FROM xquar WHERE CAST(event_time AS DATE) = {AS_OF}) AS q_today,
    (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(28,2)) FROM xs WHERE direction = 'CREDIT'
       AND CAST(COALESCE(txn_datetime_local, event_time) AS DATE) = {AS_OF}) AS credit_today,
    (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(28,2)) FROM xs WHERE direction = 'DEBIT'
       AND CAST(COALESCE(txn_datetime_local, event_time) AS DATE) = {AS_OF}) AS debit_today
)"""

_UPSERT_NEWER = silver_select(
    "(SELECT * FROM xs) t", f"CASE WHEN r = 1 THEN {SILVER_NOW_2} ELSE {SILVER_NOW} END")
_UPSERT_OLDER = silver_select(
    "(SELECT * FROM xs) t", f"CASE WHEN r = 1 THEN {SILVER_NOW} ELSE {SILVER_NOW_2} END")

ORACLES: dict[str, str] = {
    "bronze_stamp": with_alerts(
        f"SELECT id, thread_id, subject, sender, recipient, body, snippet, event_time, ingestion_time, "
        f"{BRONZE_NOW} AS _bronze_ingested_at, 'landing' AS _source_table FROM landing"),
    "text_normalise": with_alerts(
        "SELECT id, event_time, CASE WHEN body IS NULL THEN ' Transaction alert' "
        "ELSE body || ' ' || snippet || ' Transaction alert' END AS text FROM landing"),
    "parse_amount": with_alerts("SELECT id, event_time, amount FROM xp"),
    "parse_labels": with_alerts("SELECT id, event_time, bank, txn_type, direction, currency FROM xp"),
    "parse_parties": with_alerts(
        "SELECT id, event_time, txn_ref, vpa, counterparty, card_last4, account_last4 FROM xp"),
    "parse_places": with_alerts("SELECT id, event_time, location_city, location_place FROM xp"),
    "parse_balance_time": with_alerts(
        "SELECT id, event_time, available_balance, txn_datetime_local FROM xp"),
    "quality_flags": with_alerts("SELECT id, event_time, reasons, n_reasons FROM xf"),
    "silver_clean": with_alerts(f"SELECT {PARSED_VIEW} FROM xclean"),
    "silver_quarantine": with_alerts(f"SELECT {PARSED_VIEW}, reasons FROM xquar"),
    "dedup_latest": with_alerts(f"SELECT {PARSED_VIEW} FROM xs"),
    "upsert_first": with_alerts(silver_select(
        "(SELECT * FROM xclean WHERE r = 0) t", SILVER_NOW)),
    "upsert_newer_wins": with_alerts(_UPSERT_NEWER),
    "upsert_older_kept": with_alerts(_UPSERT_OLDER),
    "gold_daily": with_alerts(GOLD_DAILY),
    "gold_merchant": with_alerts("""
SELECT counterparty, vpa, txn_type, direction, currency, COUNT(*) AS txn_count,
  CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount, MIN(event_time) AS first_seen, MAX(event_time) AS last_seen
FROM xs WHERE counterparty IS NOT NULL AND counterparty <> ''
GROUP BY 1, 2, 3, 4, 5"""),
    "gold_recon": f"WITH {ALERTS},{RECON}\nSELECT * FROM recon",
    "gold_failures": f"WITH {ALERTS},{FAILURES}\nSELECT * FROM gfail",
    "kpi_alltime": f"WITH {ALERTS},{KPIS}\n"
                   "SELECT bronze_total, silver_clean_total, quarantine_total, credit_total, debit_total FROM kpi",
    "kpi_day": f"WITH {ALERTS},{KPIS}\n"
               "SELECT bronze_today, clean_today, q_today, credit_today, debit_today FROM kpi",
    "failure_kpi": f"WITH {ALERTS},{KPIS}\n"
                   "SELECT bronze_total AS ingestion_total, "
                   "bronze_total - silver_clean_total + quarantine_total AS failure_total, "
                   "quarantine_total, bronze_total - silver_clean_total - quarantine_total AS dropout_total, "
                   "bronze_today AS ingestion_today, bronze_today - clean_today + q_today AS failure_today, "
                   "q_today AS quarantine_today, bronze_today - clean_today - q_today AS dropout_today FROM kpi",
    "layer_counts": f"WITH {ALERTS},{RECON},{FAILURES}\n"
                    "SELECT 'bronze' AS layer, COUNT(*) AS row_count FROM landing "
                    "UNION ALL SELECT 'parsed', COUNT(*) FROM xf "
                    "UNION ALL SELECT 'silver_clean', COUNT(*) FROM xclean "
                    "UNION ALL SELECT 'silver_quarantine', COUNT(*) FROM xquar "
                    "UNION ALL SELECT 'silver', COUNT(*) FROM xs "
                    "UNION ALL SELECT 'gold_daily', COUNT(*) FROM (SELECT DISTINCT CAST(event_time AS DATE), bank, "
                    "txn_type, direction, currency FROM xs) t "
                    "UNION ALL SELECT 'gold_merchant', COUNT(*) FROM (SELECT DISTINCT counterparty, vpa, txn_type, "
                    "direction, currency FROM xs WHERE counterparty IS NOT NULL AND counterparty <> '') t "
                    "UNION ALL SELECT 'gold_recon', COUNT(*) FROM recon "
                    "UNION ALL SELECT 'gold_failures', COUNT(*) FROM gfail",
}

# --------------------------------------------------------------------------- ledger queries
ORACLES.update({
    "daily_credit_debit": with_ledger(f"""
SELECT txn_date, direction, CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(38,2)) AS amount
FROM lgold WHERE txn_date BETWEEN {START} AND {END} GROUP BY 1, 2"""),
    "directions_present": with_ledger(f"""
SELECT has_debit, has_credit,
  CASE WHEN has_debit AND has_credit THEN 'BOTH' WHEN has_debit THEN 'DEBIT_ONLY'
       WHEN has_credit THEN 'CREDIT_ONLY' ELSE 'NONE' END AS directions
FROM (SELECT COALESCE(bool_or(direction = 'DEBIT'), false) AS has_debit,
             COALESCE(bool_or(direction = 'CREDIT'), false) AS has_credit
      FROM lgold WHERE txn_date BETWEEN {START} AND {END}) t"""),
    "daily_spend": with_ledger(f"""
SELECT effective_date AS day, CAST(SUM(amount) AS DECIMAL(28,2)) AS daily_debit, COUNT(*) AS txn_count
FROM ledger WHERE direction = 'DEBIT' AND effective_date >= {AS_OF} - INTERVAL {fx.WINDOW_DAYS} DAY
GROUP BY 1"""),
})

_CALENDAR = f"""
spine AS (SELECT CAST(unnest(generate_series({AS_OF} - INTERVAL {fx.WINDOW_DAYS} DAY,
                                              CAST({AS_OF} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day),
spend AS (
  SELECT effective_date AS day, SUM(amount) AS s, COUNT(*) AS n FROM ledger
  WHERE direction = 'DEBIT' AND effective_date BETWEEN {AS_OF} - INTERVAL {fx.WINDOW_DAYS} DAY AND {AS_OF}
  GROUP BY 1
),
cal AS (
  SELECT sp.day, CAST(COALESCE(s.s, 0) AS DECIMAL(28,2)) AS daily_debit, COALESCE(s.n, 0) AS txn_count
  FROM spine sp LEFT JOIN spend s ON sp.day = s.day
),
cal2 AS (
  SELECT day, daily_debit, txn_count, daily_debit > {fx.THRESHOLD} AS over_threshold,
    CAST(CASE WHEN daily_debit > {fx.THRESHOLD} THEN daily_debit - {fx.THRESHOLD} ELSE 0 END AS DECIMAL(28,2))
      AS excess
  FROM cal
)"""

ORACLES.update({
    "spend_calendar": f"WITH {LEDGER},{_CALENDAR}\nSELECT * FROM cal2",
    "threshold_summary": f"WITH {LEDGER},{_CALENDAR}\n"
                         f"SELECT COUNT(*) FILTER (WHERE daily_debit > {fx.THRESHOLD}) AS days_over, "
                         f"COUNT(*) FILTER (WHERE daily_debit <= {fx.THRESHOLD}) AS days_under, "
                         f"CAST(COALESCE(SUM(daily_debit), 0) AS DECIMAL(38,2)) AS window_total, "
                         f"CAST(COALESCE(MAX(excess), 0) AS DECIMAL(28,2)) AS max_excess FROM cal2",
    "top_merchants": with_ledger(f"""
SELECT counterparty, CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount, COUNT(*) AS txn_count
FROM ledger
WHERE effective_date BETWEEN {START} AND {END} AND counterparty IS NOT NULL AND direction = 'DEBIT'
GROUP BY counterparty ORDER BY total_amount DESC, counterparty ASC LIMIT {fx.TOP_N}"""),
    "latest_one": with_ledger("""
SELECT effective_ts AS txn_ts, amount, bank, txn_type, direction, counterparty, vpa,
  CASE WHEN upper(direction) = 'DEBIT' THEN 'DEBITED' WHEN upper(direction) = 'CREDIT' THEN 'CREDITED'
       ELSE upper(direction) END AS dir_word,
  COALESCE(NULLIF(counterparty, ''), NULLIF(vpa, ''), '—') AS merchant
FROM ledger ORDER BY effective_ts DESC NULLS LAST, id DESC NULLS LAST LIMIT 1"""),
    "latest_five": with_ledger(f"""
SELECT effective_ts AS "When", bank AS "Bank", txn_type AS "Type", direction AS "Dir", amount AS "Amount",
  currency AS "Ccy", counterparty AS "Counterparty", vpa AS "VPA", txn_ref AS "Ref"
FROM ledger WHERE effective_date BETWEEN {START} AND {END}
ORDER BY effective_ts DESC NULLS LAST, id DESC NULLS LAST LIMIT 5"""),
    "ledger_page": with_ledger(f"""
SELECT effective_ts, id, bank, txn_type, direction, amount, currency, counterparty, vpa, txn_ref
FROM ledger ORDER BY effective_ts DESC NULLS LAST, id DESC NULLS LAST
LIMIT {fx.PAGE_SIZE} OFFSET {2 * fx.PAGE_SIZE}"""),
    "ledger_keyset": with_ledger(f"""
SELECT effective_ts, id, bank, txn_type, direction, amount, currency, counterparty, vpa, txn_ref
FROM ledger
WHERE effective_ts < TIMESTAMP '2001-07-01 12:00:00'
   OR (effective_ts = TIMESTAMP '2001-07-01 12:00:00' AND id < 'msg-5')
ORDER BY effective_ts DESC NULLS LAST, id DESC NULLS LAST LIMIT {fx.PAGE_SIZE}"""),
    "ledger_csv": with_ledger(f"""
SELECT effective_ts, id, bank, txn_type, direction, amount, currency, counterparty, vpa, txn_ref
FROM ledger"""),
    "ledger_by_id": with_ledger(f"""
SELECT effective_ts, id, bank, txn_type, direction, amount, currency, counterparty, vpa, txn_ref
FROM ledger WHERE id IN ({", ".join(f"'{x}'" for x in LOOKUP_IDS)})"""),
})

# --------------------------------------------------------------------------- quarantine views
ORACLES.update({
    "quarantine_grid": with_alerts(f"""
SELECT {SILVER_NOW} AS "When", id AS "ID", sender AS "Sender", subject AS "Subject", reasons AS "Reasons",
  amount AS "Amount", direction AS "Dir", txn_type AS "Type"
FROM xquar
ORDER BY id DESC NULLS LAST, event_time DESC NULLS LAST, amount DESC NULLS LAST, reasons ASC,
  sender ASC NULLS LAST, direction ASC, txn_type ASC
LIMIT 500"""),
    "failure_list": f"WITH {ALERTS},{FAILURES}\n"
                    'SELECT txn_date AS "Date", reason AS "Reason", failure_count AS "Count" FROM gfail',
})

ORACLES["quarantine_today"] = with_alerts(f"""
SELECT event_time AS "When", id AS "ID", sender AS "Sender", subject AS "Subject", reasons AS "Reasons",
  amount AS "Amount", direction AS "Dir", txn_type AS "Type"
FROM xquar WHERE CAST(event_time AS DATE) = {AS_OF}
ORDER BY event_time DESC, id DESC NULLS LAST, amount DESC NULLS LAST, reasons ASC,
  sender ASC NULLS LAST, direction ASC, txn_type ASC
LIMIT 500""")
ORACLES["failures_today"] = (f"WITH {ALERTS},{FAILURES}\n"
                             'SELECT txn_date AS "Date", reason AS "Reason", failure_count AS "Count" FROM gfail '
                             f"WHERE txn_date = {AS_OF}")

_REASONS = ["mandatory_field_missing:id", "mandatory_field_missing:sender", "mandatory_field_missing:event_time",
            "mandatory_field_missing:body_and_snippet", "invalid_amount", "invalid_direction"]
_PAIRS = ", ".join(
    f"CASE WHEN list_contains(string_split(q.reasons, ','), '{r}') THEN '{r}:' || "
    f"COALESCE((SELECT g.failure_count FROM gfail g WHERE g.txn_date IS NOT DISTINCT FROM "
    f"CAST(q.event_time AS DATE) AND g.reason = '{r}'), 0) END"
    for r in _REASONS)

ORACLES["quarantine_with_counts"] = f"WITH {ALERTS},{FAILURES}\n" + f"""
SELECT q.id, q.event_time, CAST(q.event_time AS DATE) AS txn_date, q.sender, q.amount, q.direction,
  q.reasons, concat_ws(',', {_PAIRS}) AS reason_counts
FROM xquar q"""

# --------------------------------------------------------------------------- operations
_RUNS = f"""
runs AS (
  SELECT CAST(n_nationkey AS BIGINT) AS run_id, CAST(n_regionkey AS BIGINT) AS job_id,
    CAST({AS_OF} - to_days(n_nationkey) AS TIMESTAMP) AS start_time,
    CASE n_nationkey % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'RUNNING' ELSE 'CANCELED' END
      AS state,
    CAST(n_nationkey + 60 AS BIGINT) AS duration_s
  FROM nation
)"""

ORACLES.update({
    "runs_with_recon": f"WITH {ALERTS},{RECON},{_RUNS}\n"
                       "SELECT r.run_id, r.job_id, r.start_time, r.state, r.duration_s, c.txn_date, "
                       "c.ingested_count, c.processed_count, c.failed_count, c.duplicates_dropped, c.pass_rate_pct "
                       "FROM runs r LEFT JOIN recon c ON CAST(r.start_time AS DATE) = c.txn_date",
    "runs_last10": f"WITH {ALERTS},{RECON},{_RUNS},\n"
                   "newest AS (SELECT * FROM runs WHERE job_id IN (0, 1, 3) ORDER BY start_time DESC, run_id DESC LIMIT 10)\n"
                   "SELECT r.run_id, r.job_id, r.start_time, r.state, r.duration_s, c.txn_date, "
                   "c.ingested_count, c.processed_count, c.failed_count, c.duplicates_dropped, c.pass_rate_pct "
                   "FROM newest r LEFT JOIN recon c ON CAST(r.start_time AS DATE) = c.txn_date",
    "runs_fallback": f"WITH {ALERTS},{RECON}\n"
                     "SELECT CAST(NULL AS BIGINT) AS run_id, CAST(NULL AS BIGINT) AS job_id, "
                     "CAST(NULL AS TIMESTAMP) AS start_time, CAST(NULL AS VARCHAR) AS state, "
                     "CAST(NULL AS BIGINT) AS duration_s, * FROM recon",
})

# --------------------------------------------------------------------------- ingest
_NOW_TS = "TIMESTAMP '2001-08-02 00:00:00'"
ORACLES.update({
    "ingest_messages": f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS thread_id,
  'Conversation ' || CAST(conv_id AS VARCHAR) AS subject, role AS sender, 'me@example.com' AS recipient,
  text AS body, substr(text, 1, 200) AS snippet, {_NOW_TS} AS event_time, {_NOW_TS} AS ingestion_time
FROM conversations
WHERE conv_id % 3 = 0 AND conv_id % 2 = 0 AND turn <> 0""",
    "json_append": f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS thread_id,
  'Conversation ' || CAST(conv_id AS VARCHAR) AS subject, role AS sender, 'me@example.com' AS recipient,
  text AS body, substr(text, 1, 200) AS snippet, {_NOW_TS} AS event_time, {_NOW_TS} AS ingestion_time
FROM conversations
WHERE (conv_id + turn) % 10 <> 0 AND (conv_id + turn) % 15 <> 0""",
    "json_reject": """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id,
  CASE WHEN (conv_id + turn) % 10 = 0 THEN 'malformed' ELSE 'schema_mismatch' END AS reason
FROM conversations
WHERE (conv_id + turn) % 10 = 0 OR (conv_id + turn) % 15 = 0""",
})

_MESSAGES = """
m AS (
  SELECT conv_id, turn, conv_id + turn AS n, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
    role AS sender, text AS body, conv_id || '/' || (turn // 4) AS body_id,
    (conv_id + turn // 4) % 9 = 0 AS cut
  FROM conversations WHERE (conv_id + turn) % 10 <> 0
)"""
ORACLES.update({
    "ingest_seen": """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id FROM conversations
WHERE turn = 0 OR (conv_id % 3 = 0 AND conv_id % 2 = 0)""",
    "json_body_append": f"""WITH {_MESSAGES}
SELECT body_id, id, sender, body, {_NOW_TS} AS event_time FROM m WHERE NOT cut AND n % 15 <> 0""",
    "json_body_reject": f"""WITH {_MESSAGES}
SELECT body_id, 'malformed' AS reason, CAST(1 AS BIGINT) AS records FROM m WHERE cut GROUP BY body_id
UNION ALL
SELECT body_id, 'schema_mismatch', COUNT(*) FROM m WHERE NOT cut AND n % 15 = 0 GROUP BY body_id""",
})

# --------------------------------------------------------------------------- free text, by this engine's own regex
def _free_text(table: str, key: str, number: str, sender: str) -> str:
    traps = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TRAPS))

    def got(pattern: str) -> str:
        return f"nullif(regexp_extract(t, '{pattern}', 1), '')"

    def money(*patterns: str) -> str:
        return f"TRY_CAST(replace(COALESCE({', '.join(map(got, patterns))}), ',', '') AS DECIMAL(18,2))"

    def label(column: str, tests: list[tuple[str, str]], default: str) -> str:
        cases = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{x}'" for p, x in tests)
        return f"CASE {cases} ELSE '{default}' END"

    return f"""
WITH raw AS (
  SELECT {key} AS id, {sender} AS sender, text,
    substr(text, 1, 40) || ' ' || CASE ({number}) % {len(TRAPS)} {traps} END || ' ' || text AS body
  FROM {table}
),
norm AS (SELECT id, sender, regexp_replace(COALESCE(body, '') || ' ' || COALESCE(text, '') || ' ',
                                           '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t, body, text FROM raw),
parsed AS (
  SELECT id, {label("COALESCE(sender, '')", P.BANK_TESTS, P.BANK_DEFAULT)} AS bank,
    {label("t", P.TXN_TYPE_TESTS, P.TXN_TYPE_DEFAULT)} AS txn_type,
    {label("t", P.DIRECTION_TESTS, P.DIRECTION_DEFAULT)} AS direction,
    {money(P.AMOUNT_ANCHORED, P.AMOUNT_POSTFIX, P.AMOUNT_GENERIC)} AS amount,
    {label("t", P.CURRENCY_TESTS, P.CURRENCY_DEFAULT)} AS currency,
    {got(P.REF)} AS txn_ref, {got(P.VPA)} AS vpa, trim({got(P.COUNTERPARTY)}) AS counterparty,
    COALESCE({got(P.CARD_ENDING)}, {got(P.CARD_STARS)}) AS card_last4, {got(P.ACCOUNT)} AS account_last4,
    {got(P.CITY)} AS location_city, trim({got(P.PLACE)}) AS location_place, {money(P.BALANCE)} AS available_balance,
    TRY_STRPTIME({got(P.LOCAL_DT)}, '%d-%m-%Y %H:%M:%S') AS txn_datetime_local, sender, body, text
  FROM norm
)
SELECT id, bank, txn_type, direction, amount, currency, txn_ref, vpa, counterparty, card_last4, account_last4,
  location_city, location_place, available_balance, txn_datetime_local,
  concat_ws(',', CASE WHEN id IS NULL THEN '{P.REASON_ID}' END, CASE WHEN sender IS NULL THEN '{P.REASON_SENDER}' END,
    CASE WHEN body IS NULL AND text IS NULL THEN '{P.REASON_BODY}' END,
    CASE WHEN amount IS NULL OR amount <= 0 THEN '{P.REASON_AMOUNT}' END,
    CASE WHEN direction NOT IN ('DEBIT', 'CREDIT') THEN '{P.REASON_DIRECTION}' END) AS reasons
FROM parsed"""


ORACLES["parse_documents"] = _free_text("documents", "CAST(doc_id AS VARCHAR)", "doc_id", "source")
ORACLES["parse_conversations"] = _free_text("conversations", "conv_id || '-' || turn", "conv_id + turn", "role")

# --------------------------------------------------------------------------- change feed / mirror
_CHANGE = {c: c for c in ("id", "thread_id", "sender")} | {
    "recipient": "'me@example.com'", "subject": "'Transaction alert'"} | {
    c: c for c in ("bank", "txn_type", "direction", "amount", "currency", "txn_ref", "vpa", "counterparty")} | {
    c: "CAST(NULL AS VARCHAR)" for c in ("card_last4", "account_last4", "location_city", "location_place")} | {
    "available_balance": "CAST(NULL AS DECIMAL(18,2))", "txn_datetime_local": "txn_datetime_local",
    "event_time": "event_time", "ingestion_time": "event_time", "_bronze_ingested_at": "event_time + INTERVAL 1 DAY",
    "_silver_processed_at": "event_time + INTERVAL 1 DAY", "effective_ts": "effective_ts",
    "effective_date": "effective_date"}
_CHG_COLS = ", ".join(_CHANGE)


def _image(**changed: str) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in (_CHANGE | changed).items())


_AMOUNT = "CASE WHEN okey % 10 = 2 THEN CAST(amount + 1 AS DECIMAL(18,2)) ELSE amount END"
_PAIR = f"""
bef AS (SELECT {_image()} FROM ledger WHERE okey % 10 <> 0),
aft AS (SELECT {_image(amount=_AMOUNT)} FROM ledger WHERE okey % 10 <> 1),
xs AS (SELECT {_image(amount=_AMOUNT, event_time="CASE WHEN okey % 10 = 3 THEN event_time + INTERVAL 1 DAY ELSE event_time END",
                      vpa="CASE WHEN okey % 10 = 3 THEN NULL ELSE vpa END")}
       FROM ledger WHERE okey % 10 NOT IN (1, 4))"""
GOLD_MERCHANT = """
SELECT counterparty, vpa, txn_type, direction, currency, COUNT(*) AS txn_count,
  CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount, MIN(event_time) AS first_seen, MAX(event_time) AS last_seen
FROM xs WHERE counterparty IS NOT NULL AND counterparty <> ''
GROUP BY 1, 2, 3, 4, 5"""

ORACLES.update({
    "change_feed": f"WITH {LEDGER},{_PAIR}\n" + f"""
SELECT {_CHG_COLS}, 'insert' AS _change_type, CAST(1 AS BIGINT) AS _commit_version
FROM aft WHERE id NOT IN (SELECT id FROM bef)
UNION ALL
SELECT {_CHG_COLS}, 'delete', CAST(1 AS BIGINT) FROM bef WHERE id NOT IN (SELECT id FROM aft)
UNION ALL
SELECT {", ".join(f"a.{c}" for c in _CHANGE)}, 'update', CAST(1 AS BIGINT)
FROM aft a JOIN bef b ON a.id = b.id WHERE a.amount <> b.amount""",
    "mirror_apply": f"WITH {LEDGER},{_PAIR}\nSELECT * FROM aft",
    "stream_mirror": f"WITH {LEDGER},{_PAIR}\nSELECT * FROM aft",
    "mirror_out_of_order": f"WITH {LEDGER},{_PAIR}\nSELECT * FROM aft",
    "mirror_silver": f"WITH {LEDGER},{_PAIR}\nSELECT * FROM xs",
    "mirror_gold_daily": f"WITH {LEDGER},{_PAIR}\n{GOLD_DAILY}",
    "mirror_gold_merchant": f"WITH {LEDGER},{_PAIR}\n{GOLD_MERCHANT}",
    "mixed_layer": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "stream_restarted": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "stream_gold_merchant": with_alerts(GOLD_MERCHANT),
    "stream_gold_daily": with_alerts(GOLD_DAILY),
    "stream_silver": with_alerts(silver_select("xs", SILVER_NOW)),
    "stream_events_daily": """
SELECT CAST(ts AS DATE) AS txn_date, event_type, COUNT(*) AS event_count,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_value
FROM events GROUP BY 1, 2""",
    "stream_dedup": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
})

# --------------------------------------------------------------------------- previews
ORACLES.update({
    "gold_daily_recent": with_alerts(f"""
SELECT * FROM ({GOLD_DAILY}) g
ORDER BY txn_date DESC NULLS LAST, bank, txn_type, direction, currency LIMIT 10"""),
    "gold_merchant_top": with_alerts("""
SELECT counterparty, vpa, txn_type, direction, currency, COUNT(*) AS txn_count,
  CAST(SUM(amount) AS DECIMAL(28,2)) AS total_amount, MIN(event_time) AS first_seen, MAX(event_time) AS last_seen
FROM xs WHERE counterparty IS NOT NULL AND counterparty <> ''
GROUP BY 1, 2, 3, 4, 5
ORDER BY total_amount DESC NULLS LAST, counterparty, vpa ASC NULLS FIRST, txn_type, direction, currency
LIMIT 10"""),
})

ORACLES["stream_gold_failures"] = f"WITH {ALERTS},{FAILURES}\nSELECT * FROM gfail"

ORACLES["upsert_bucketed"] = ORACLES["upsert_newer_wins"]
ORACLES["upsert_months"] = ORACLES["upsert_newer_wins"]

# --------------------------------------------------------------------------- event time: gate, closed days
ORACLES["stream_dedup_watermark"] = """
WITH d AS (SELECT *, CAST(floor((day(ts) - 1) / 3) AS INT) + CASE WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS arr FROM events),
arrived AS (SELECT * FROM d UNION ALL SELECT * REPLACE (arr + 1 AS arr) FROM d WHERE event_id % 3 = 0),
newest AS (SELECT arr, max(ts) AS newest FROM arrived GROUP BY arr),
clock AS (SELECT arr, max(newest) OVER (ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 4 DAY AS passed FROM newest),
judged AS (SELECT event_id, ts, user_id, event_type, value, props, ts <= coalesce(passed, ts - INTERVAL 1 DAY) AS late
           FROM arrived JOIN clock USING (arr))
SELECT DISTINCT event_id, ts, user_id, event_type, value, props, 'events_once' AS layer FROM judged WHERE NOT late
UNION ALL
SELECT event_id, ts, user_id, event_type, value, props, 'events_late' FROM judged WHERE late"""

_GATED = f"""{LEDGER},
arrived AS (SELECT *, LEAST(LEAST(GREATEST(floor((year(event_time) - {fx.FIRST_YEAR}) / 2), 0), 3)
                            + CASE WHEN okey % 17 = 0 THEN 1 ELSE 0 END, 3) AS arr FROM ledger),
newest AS (SELECT arr, max(event_time) AS newest FROM arrived GROUP BY arr),
clock AS (SELECT arr, max(newest) OVER (ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 DAY AS passed FROM newest),
judged AS (SELECT *, event_time <= coalesce(passed, event_time - INTERVAL 1 DAY) AS late FROM arrived JOIN clock USING (arr)),
xs AS (SELECT * FROM judged WHERE NOT late
       AND CAST(event_time AS DATE) + INTERVAL 1 DAY <= (SELECT max(newest) FROM newest) - INTERVAL 30 DAY)"""
ORACLES["stream_gold_daily_closed"] = f"WITH {_GATED}\n{GOLD_DAILY}"
ORACLES["stream_ledger_late"] = f"WITH {_GATED}\nSELECT {', '.join(LEDGER_COLUMNS)} FROM judged WHERE late"
ORACLES["stream_recon"] = f"""WITH {ALERTS},{RECON}
SELECT * FROM recon WHERE txn_date + INTERVAL 1 DAY <= (SELECT max(event_time) FROM landing) - INTERVAL 30 DAY"""
ORACLES["change_feed_digest"] = ORACLES["change_feed"]
ORACLES["stream_progress"] = """
SELECT event_id % 4 AS batch_id, COUNT(*) AS input_rows, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(user_id) AS users
FROM events GROUP BY 1"""
ORACLES["ledger_page_deep"] = with_ledger(f"""
SELECT effective_ts, id, bank, txn_type, direction, amount, currency, counterparty, vpa, txn_ref
FROM ledger ORDER BY effective_ts DESC NULLS LAST, id DESC NULLS LAST
LIMIT {fx.PAGE_SIZE} OFFSET {DEEP_PAGE * fx.PAGE_SIZE}""")
ORACLES["stream_ingest"] = ORACLES["ingest_messages"]
ORACLES["json_append_rescued"] = """
SELECT event_id AS request_id, 'e-' || event_id AS id, event_type AS sender,
  CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 4 >= 2 THEN user_id END AS second_tag, event_id % 4 = 0 AS nothing_rescued
FROM events"""
ORACLES["merchant_clustered"] = with_ledger(f"""
SELECT effective_ts, id, bank, txn_type, direction, amount, currency, counterparty, vpa, txn_ref
FROM ledger WHERE counterparty = 'SHOP 7' AND effective_date BETWEEN {START} AND {END}""")
