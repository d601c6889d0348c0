"""Getting messages in: bronze stamping (S2), mailbox batch ingest (S4, J7),
schema-enforced JSON append (S5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions.columns import timestamp_micros, unix_micros_ntz
from ..operators.upsert import newest_per_key
from ..schemas import LANDING
from .store import LayerStore

CORRUPT = "_corrupt_record"


def to_bronze(landing: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    """Landing rows + load stamp + source name; never fails on content."""
    stamp = F.current_timestamp() if now is None else now
    return landing.withColumn("_bronze_ingested_at", stamp).withColumn("_source_table", F.lit(source))


def ingest_messages(threads: DataFrame, messages: DataFrame, seen: DataFrame, now_micros: int,
                    label: str = "ALERT") -> tuple[DataFrame, DataFrame]:
    """Records for every not-yet-sent message of labelled, unread threads.

    ``threads``: (thread_id, label, is_unread); ``messages``: (id, thread_id,
    subject, sender, recipient, body); ``seen``: (id). All messages of a
    matching thread count, read or not. Returns ``(records, seen')``;
    ``records`` is empty when nothing is new (the caller then skips the send).
    Both steps are joins on keys (semi on thread, anti on id) — nothing is
    gathered per thread. An id that occurs twice within a run is sent once.
    """
    wanted = threads.filter((F.col("label") == label) & F.col("is_unread")).select("thread_id")
    fresh = newest_per_key(messages.join(wanted, "thread_id", "left_semi")
                           .join(seen.select("id"), "id", "left_anti"), "id", [])
    stamp = timestamp_micros(F.lit(now_micros))
    records = fresh.select(
        "id", "thread_id", "subject", "sender", "recipient", "body",
        F.substring("body", 1, P.SNIPPET_CHARS).alias("snippet"),
        stamp.alias("event_time"),
        stamp.alias("ingestion_time"),
    )
    return records, seen.select("id").unionByName(records.select("id"))


def commit_ingest(store: LayerStore, threads: DataFrame, messages: DataFrame, now_micros: int, tag: str,
                  label: str = "ALERT") -> int:
    """One ingest run as one step: append the records to ``landing``, then remember their ids in ``seen``.

    Both appends carry ``tag``. A run that died between them is finished by running it again: the records
    committed under the tag are read back, not recomputed. Returns the number of records of the run.
    """
    nothing = store.spark.createDataFrame([], "id string")
    if not store.has_tag("landing", tag):
        seen = store.read("seen") if store.exists("seen") else nothing
        store.append(ingest_messages(threads, messages, seen, now_micros, label)[0], "landing", tag=tag)
    sent = store.read_tag("landing", tag, LANDING)
    store.append(sent.select("id"), "seen", tag=tag)
    return sent.count()


# Wire format of one record: times travel as epoch microseconds.
WIRE = StructType([f if f.name not in ("event_time", "ingestion_time") else StructField(f.name, LongType())
                   for f in LANDING.fields])


def records_to_json(records: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Encode landing rows as one JSON text per record (times as epoch micros)."""
    micros = {c: unix_micros_ntz(c) for c in ("event_time", "ingestion_time")}
    cols = [micros.get(f.name, F.col(f.name)).alias(f.name) for f in LANDING.fields]
    return records.select(*keep, F.to_json(F.struct(*cols)).alias("value"))


def split_json_array(payload: DataFrame, column: str = "value") -> DataFrame:
    """POST bodies → one row per record text, with the body's other columns.

    A body that holds a JSON array gives one row per element (none for an empty array). Any other body, a
    single object or text cut short, is one row itself, so ``append_json`` accepts or rejects it by name.
    """
    keep = [c for c in payload.columns if c != column]
    records = F.coalesce(F.from_json(column, "array<string>"), F.array(F.col(column)))
    return payload.select(*keep, F.explode(records).alias("value"))


RESCUED = "rescued"


def append_json(raw: DataFrame, column: str = "value", rescue: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse each record against the landing schema; refuse what does not fit.

    Returns ``(accepted, rejected)``. Accepted rows have the landing schema;
    rejected rows keep the raw text, any other input columns (e.g. a request
    key) and a reason, and never reach the lake: ``malformed`` (not a JSON
    object), ``empty_record`` (no field), ``unknown_field`` (a field the schema
    does not have), ``schema_mismatch`` (a field of the wrong type). Missing
    fields are NULL; a number or truth value in a text field is its text.

    With ``rescue`` no record is rejected as ``unknown_field``: the accepted rows have a VARIANT column ``rescued``, an
    object of the fields that the schema does not have, with their types and nested values (NULL if there are none).
    """
    schema = StructType(WIRE.fields + [StructField(CORRUPT, StringType())])
    keep = [c for c in raw.columns if c != column]
    parsed = raw.select(*keep, F.col(column).alias("raw"),
                        F.map_keys(F.from_json(column, "map<string,string>")).alias("names"),
                        F.from_json(column, schema, {"mode": "PERMISSIVE",
                                                     "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    known = F.array(*(F.lit(f.name) for f in WIRE.fields))
    reason = (F.when(F.col("names").isNull() | F.col("r").isNull(), F.lit("malformed"))
              .when(F.size("names") == 0, F.lit("empty_record"))
              .when(F.lit(not rescue) & (F.size(F.array_except("names", known)) > 0), F.lit("unknown_field"))
              .when(F.col(f"r.{CORRUPT}").isNotNull(), F.lit("schema_mismatch")))
    judged = parsed.withColumn("reason", reason)
    accepted = judged.filter("reason IS NULL").select(
        *keep,
        *[(timestamp_micros(F.col(f"r.{f.name}")) if f.name in ("event_time", "ingestion_time")
           else F.col(f"r.{f.name}")).alias(f.name) for f in LANDING.fields],
        *([_rescued(known).alias(RESCUED)] if rescue else []))
    return accepted, judged.filter("reason IS NOT NULL").select(*keep, "raw", "reason")


def _rescued(known: Column) -> Column:
    """The fields of the record that are not ``known``, as one VARIANT object."""
    other = F.map_filter(F.from_json("raw", "map<string,variant>"), lambda name, _: ~F.array_contains(known, name))
    return F.when(F.size(F.array_except("names", known)) > 0, F.to_variant_object(other))
