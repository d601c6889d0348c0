"""alertledger — bank-alert text → trusted ledger, as Spark DataFrame operators.

Typical batch use::

    from alertledger import LayerStore, bronze_to_silver, silver_to_gold, shared_dir
    store = LayerStore(spark, shared_dir(spark) + "/ledger")
    bronze_to_silver(spark.read.parquet(landing_path), store)
    silver_to_gold(store)

Every operator below is a DataFrame → DataFrame function (see README.md).
"""

from .operators.changes import apply_changes, change_feed
from .operators.gold import daily_summary, failure_reason_counts, merchant_summary, recon_metrics
from .operators.parse import clean_rows, flagged, parse_alerts, quarantine_rows
from .operators.upsert import newest_per_key, to_silver, upsert
from .plans.medallion import bronze_to_silver, layers, silver_to_gold
from .session import build_session, configure, shared_dir
from .sources.ingest import append_json, ingest_messages, to_bronze
from .sources.store import LayerStore

__all__ = [
    "LayerStore", "append_json", "apply_changes", "bronze_to_silver", "build_session", "change_feed",
    "clean_rows", "configure", "daily_summary", "failure_reason_counts", "ingest_messages", "layers",
    "merchant_summary", "newest_per_key", "parse_alerts", "quarantine_rows", "recon_metrics", "shared_dir",
    "silver_to_gold", "to_bronze", "to_silver", "upsert",
]
