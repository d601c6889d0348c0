"""Explicit schemas for each layer, and ``conform`` to enforce them.

Timestamps are ``timestamp_ntz`` throughout the fixtures: the driver tables
store zone-less wall clocks, and the bank's local transaction time is a wall
clock by nature. The operators themselves accept either timestamp flavour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (DateType, DecimalType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

MONEY = DecimalType(18, 2)
TS = TimestampNTZType()

LANDING = StructType([
    StructField("id", StringType()),
    StructField("thread_id", StringType()),
    StructField("subject", StringType()),
    StructField("sender", StringType()),
    StructField("recipient", StringType()),
    StructField("body", StringType()),
    StructField("snippet", StringType()),
    StructField("event_time", TS),
    StructField("ingestion_time", TS),
])

BRONZE = StructType(LANDING.fields + [
    StructField("_bronze_ingested_at", TS),
    StructField("_source_table", StringType()),
])

# Column order of the parsed / clean / quarantine layers.
PARSED_COLUMNS = [
    "id", "thread_id", "sender", "recipient", "subject",
    "bank", "txn_type", "direction",
    "amount", "currency",
    "txn_ref", "vpa", "counterparty",
    "card_last4", "account_last4",
    "location_city", "location_place",
    "available_balance", "txn_datetime_local",
    "event_time", "ingestion_time",
    "_bronze_ingested_at",
    "body", "snippet",
    "failure_reasons",
    "_silver_processed_at",
]

# Silver = parsed without raw text and reasons, plus the materialised
# effective time/date (COALESCE(txn_datetime_local, event_time)).
SILVER = StructType([
    StructField("id", StringType()),
    StructField("thread_id", StringType()),
    StructField("sender", StringType()),
    StructField("recipient", StringType()),
    StructField("subject", StringType()),
    StructField("bank", StringType()),
    StructField("txn_type", StringType()),
    StructField("direction", StringType()),
    StructField("amount", MONEY),
    StructField("currency", StringType()),
    StructField("txn_ref", StringType()),
    StructField("vpa", StringType()),
    StructField("counterparty", StringType()),
    StructField("card_last4", StringType()),
    StructField("account_last4", StringType()),
    StructField("location_city", StringType()),
    StructField("location_place", StringType()),
    StructField("available_balance", MONEY),
    StructField("txn_datetime_local", TS),
    StructField("event_time", TS),
    StructField("ingestion_time", TS),
    StructField("_bronze_ingested_at", TS),
    StructField("_silver_processed_at", TS),
    StructField("effective_ts", TS),
    StructField("effective_date", DateType()),
])

RUNS = StructType([
    StructField("run_id", LongType()),
    StructField("job_id", LongType()),
    StructField("start_time", TS),
    StructField("state", StringType()),
    StructField("duration_s", LongType()),
])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select ``schema``'s columns in order, casting each; missing → typed NULL.

    A column that already has its type is selected as it is, not under a new alias: chains of aliases make
    the optimizer's constraint inference grow exponentially.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        if present.get(field.name) == field.dataType:
            cols.append(F.col(field.name))
        else:
            value = F.col(field.name) if field.name in present else F.lit(None)
            cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)
