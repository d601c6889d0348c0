"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Every query reads the driver tables (or frames Spark derives from them) in
full; parameters are the fixed ledger parameters of ``sources.fixtures``.
The matching DuckDB SQL is in ``plans.oracles``. Queries that need durable
state (exports, streams) write under the session's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import normalised_text, reasons_text, timestamp_micros
from ..operators import changes, gold, ledger, ops
from ..operators.parse import DQ, clean_rows, flagged, parse_alerts, quarantine_rows
from ..operators.upsert import newest_per_key, to_silver, upsert, upsert_bucketed
from ..schemas import SILVER, conform
from ..session import configure, scratch_dir
from ..sources import export, fixtures as fx
from ..sources.ingest import (append_json, commit_ingest, ingest_messages, records_to_json, split_json_array,
                              to_bronze)
from ..sources.store import LayerStore

Query = Callable[[SparkSession, str], DataFrame]

NOW_MICROS = 996_710_400_000_000  # 2001-08-02 00:00:00 UTC, the fixed "send" clock

PARSED_VIEW = ["id", "thread_id", "sender", "recipient", "subject", "bank", "txn_type", "direction",
               "amount", "currency", "txn_ref", "vpa", "counterparty", "card_last4", "account_last4",
               "location_city", "location_place", "available_balance", "txn_datetime_local",
               "event_time", "ingestion_time"]


# ----------------------------------------------------------------- shared lazy frames
def _bronze(spark: SparkSession, sf_dir: str, alerts: DataFrame | None = None) -> DataFrame:
    configure(spark)
    a = fx.alerts_from_orders(spark, sf_dir, tasks=_parse_tasks(spark, sf_dir)) if alerts is None else alerts
    return to_bronze(a, "landing", fx.ntz(fx.BRONZE_NOW))


PARSE_PARTITIONS = 16  # least tasks of the parse in the registered queries, and those of the bench; a cluster's own jobs name theirs


def _parse_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the orders are dealt over; their alerts are parsed in the same tasks, and no text is shuffled before."""
    return fx.tasks_for_orders(spark, sf_dir, PARSE_PARTITIONS)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_alerts(_bronze(spark, sf_dir), fx.ntz(fx.SILVER_NOW))


def _committed(spark: SparkSession, bronze: DataFrame, now: str, tasks: int | None = PARSE_PARTITIONS) -> DataFrame:
    """The flagged parse of ``bronze``, written once as a layer and read back: splits, dates and counts read
    only the columns they need, and no filter runs a pattern again. ``tasks``: None for bronze that is dealt already."""
    store = LayerStore(spark, scratch_dir(spark, "parsed"))
    parsed = flagged(parse_alerts(bronze, fx.ntz(now), tasks))
    store.write(parsed, "parsed", partition_by=[DQ])
    return store.read("parsed", schema=parsed.schema)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, _bronze(spark, sf_dir), fx.SILVER_NOW, None)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(None, to_silver(clean_rows(_flagged(spark, sf_dir))))


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    bronze = _bronze(spark, sf_dir)
    parsed = _committed(spark, bronze, fx.SILVER_NOW, None)
    clean, quarantine = clean_rows(parsed), quarantine_rows(parsed)
    silver = upsert(None, to_silver(clean))
    return {"bronze": bronze, "parsed": parsed, "silver_clean": clean, "silver_quarantine": quarantine,
            "silver": silver}


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return fx.ledger_orders(spark, sf_dir)


def _runs(spark: SparkSession, sf_dir: str, split: int) -> DataFrame:
    """Alerts split into runs: rows of run ``split`` only (r = 0 or r = 1)."""
    a = fx.alerts_from_orders(spark, sf_dir, keep_parts=True, tasks=_parse_tasks(spark, sf_dir))
    return a.filter(F.col("r") == split).drop("o_orderkey", "o_custkey", "r", "k")


def _silver_run(spark: SparkSession, sf_dir: str, split: int, now: str) -> DataFrame:
    bronze = _bronze(spark, sf_dir, _runs(spark, sf_dir, split))
    return to_silver(clean_rows(_committed(spark, bronze, now, None)))


# ----------------------------------------------------------------- sources / parser
def q_bronze_stamp(spark, sf_dir):
    return _bronze(spark, sf_dir)


def q_text_normalise(spark, sf_dir):
    return _bronze(spark, sf_dir).select("id", "event_time", normalised_text().alias("text"))


def q_parse_amount(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "event_time", "amount")


def q_parse_labels(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "event_time", "bank", "txn_type", "direction", "currency")


def q_parse_parties(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "event_time", "txn_ref", "vpa", "counterparty",
                                         "card_last4", "account_last4")


def q_parse_places(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "event_time", "location_city", "location_place")


def q_parse_balance_time(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "event_time", "available_balance", "txn_datetime_local")


def q_quality_flags(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "event_time", reasons_text().alias("reasons"),
                                         F.size("failure_reasons").alias("n_reasons"))


def q_silver_clean(spark, sf_dir):
    return clean_rows(_flagged(spark, sf_dir)).select(*PARSED_VIEW)


def q_silver_quarantine(spark, sf_dir):
    return quarantine_rows(_flagged(spark, sf_dir)).select(*PARSED_VIEW, reasons_text().alias("reasons"))


def q_dedup_latest(spark, sf_dir):
    return newest_per_key(clean_rows(_flagged(spark, sf_dir))).select(*PARSED_VIEW)


def q_upsert_first(spark, sf_dir):
    return upsert(None, _silver_run(spark, sf_dir, 0, fx.SILVER_NOW))


def _upserted(spark, sf_dir, runs):
    """Silver after committing the runs one by one."""
    store = LayerStore(spark, scratch_dir(spark, "upserts"))
    first, second = (_silver_run(spark, sf_dir, split, now) for split, now in zip(runs, (fx.SILVER_NOW, fx.SILVER_NOW_2), strict=True))
    store.write(upsert(None, first), "silver")
    return upsert(store.read("silver", schema=SILVER), second)


def q_upsert_newer_wins(spark, sf_dir):
    return _upserted(spark, sf_dir, (0, 1))


def q_upsert_bucketed(spark, sf_dir):
    """J2 on bucketed silver: run 0 committed bucketed by id, then run 1 merged (batch-only shuffle)."""
    buckets = fx.tasks_for_orders(spark, sf_dir, 8)
    store = LayerStore(spark, scratch_dir(spark, "upsert-bucketed"))
    first = _silver_run(spark, sf_dir, 0, fx.SILVER_NOW).repartition(buckets, "id")  # so each task writes one bucket
    store.write_bucketed(upsert(None, first), "silver", "id", buckets)
    target = store.read_bucketed("silver", "id", buckets)
    return upsert_bucketed(target, _silver_run(spark, sf_dir, 1, fx.SILVER_NOW_2), buckets)


def q_upsert_older_kept(spark, sf_dir):
    return _upserted(spark, sf_dir, (1, 0))


# ----------------------------------------------------------------- gold
def q_gold_daily(spark, sf_dir):
    return gold.daily_summary(_silver(spark, sf_dir))


def q_gold_merchant(spark, sf_dir):
    return gold.merchant_summary(_silver(spark, sf_dir))


def q_gold_recon(spark, sf_dir):
    L = _layers(spark, sf_dir)
    return gold.recon_metrics(L["bronze"], L["silver"], L["silver_quarantine"])


def q_gold_failures(spark, sf_dir):
    return gold.failure_reason_counts(quarantine_rows(_flagged(spark, sf_dir)))


def q_gold_daily_recent(spark, sf_dir):
    return ledger.recent_daily(gold.daily_summary(_silver(spark, sf_dir)), 10)


def q_gold_merchant_top(spark, sf_dir):
    return ledger.top_merchant_rows(gold.merchant_summary(_silver(spark, sf_dir)), 10)


# ----------------------------------------------------------------- KPIs
_KPI_ALL = ["bronze_total", "silver_clean_total", "quarantine_total", "credit_total", "debit_total"]
_KPI_DAY = ["bronze_today", "clean_today", "q_today", "credit_today", "debit_today"]


def _kpis(spark, sf_dir):
    L = _layers(spark, sf_dir)
    return ledger.kpis(L["bronze"], L["silver_clean"], L["silver_quarantine"], L["silver"], fx.AS_OF)


def q_kpi_alltime(spark, sf_dir):
    return _kpis(spark, sf_dir).select(*_KPI_ALL)


def q_kpi_day(spark, sf_dir):
    return _kpis(spark, sf_dir).select(*_KPI_DAY)


def q_failure_kpi(spark, sf_dir):
    return ledger.failure_kpis(_kpis(spark, sf_dir))


# ----------------------------------------------------------------- ledger (FIXTURES §3)
def q_daily_credit_debit(spark, sf_dir):
    return ledger.daily_credit_debit(gold.daily_summary(_ledger(spark, sf_dir)), fx.RANGE_START, fx.RANGE_END)


def q_directions_present(spark, sf_dir):
    return ledger.directions_present(gold.daily_summary(_ledger(spark, sf_dir)), fx.RANGE_START, fx.RANGE_END)


def q_daily_spend(spark, sf_dir):
    return ledger.daily_spend(_ledger(spark, sf_dir), fx.AS_OF, fx.WINDOW_DAYS)


def q_spend_calendar(spark, sf_dir):
    return ledger.spend_calendar(spark, _ledger(spark, sf_dir), fx.AS_OF, fx.WINDOW_DAYS, fx.THRESHOLD)


def q_threshold_summary(spark, sf_dir):
    cal = ledger.spend_calendar(spark, _ledger(spark, sf_dir), fx.AS_OF, fx.WINDOW_DAYS, fx.THRESHOLD)
    return ledger.threshold_summary(cal, fx.THRESHOLD)


def q_top_merchants(spark, sf_dir):
    return ledger.top_merchants(_ledger(spark, sf_dir), fx.RANGE_START, fx.RANGE_END, fx.TOP_N)


def q_merchant_clustered(spark, sf_dir):
    """One merchant's rows in the range, from silver clustered by date and merchant."""
    from ..operators import clustering
    store = LayerStore(spark, scratch_dir(spark, "clustered"))
    clustering.write_clustered(_ledger(spark, sf_dir), store, files=16)
    rows = clustering.of_merchant(store.read("silver_clustered"), "SHOP 7")
    return ledger.in_range(rows, "effective_date", fx.RANGE_START, fx.RANGE_END).select(*ledger.LEDGER_COLUMNS)


def q_latest_one(spark, sf_dir):
    return ledger.latest_one(_ledger(spark, sf_dir))


def q_latest_five(spark, sf_dir):
    return ledger.latest_in_range(_ledger(spark, sf_dir), fx.RANGE_START, fx.RANGE_END, 5)


def q_quarantine_grid(spark, sf_dir):
    return ledger.quarantine_grid(quarantine_rows(_flagged(spark, sf_dir)))


def q_failure_list(spark, sf_dir):
    return ledger.failure_list(gold.failure_reason_counts(quarantine_rows(_flagged(spark, sf_dir))))


LEDGER_PAGE = 2
KEYSET_CURSOR = ("2001-07-01 12:00:00", "msg-5")


def q_ledger_page(spark, sf_dir):
    return ledger.ledger_page(_ledger(spark, sf_dir), LEDGER_PAGE, fx.PAGE_SIZE)


DEEP_PAGE = 40


def q_ledger_page_deep(spark, sf_dir):
    """A deep page from the order-statistics index: the one or two parts it lies in are read."""
    from ..operators import paging
    view, store = _ledger(spark, sf_dir), LayerStore(spark, scratch_dir(spark, "pages"))
    paging.build_page_index(view, store, rows_per_part=500)
    return paging.indexed_page(store, DEEP_PAGE, fx.PAGE_SIZE, paging.page_schema(view))


def q_ledger_keyset(spark, sf_dir):
    return ledger.ledger_after(_ledger(spark, sf_dir), *KEYSET_CURSOR, size=fx.PAGE_SIZE)


def q_ledger_csv(spark, sf_dir):
    view = _ledger(spark, sf_dir).select(*ledger.LEDGER_COLUMNS)
    path = scratch_dir(spark, "ledger-csv")
    export.export_csv(view, path)
    return export.read_csv(spark, path, view.schema)


LOOKUP_IDS = ["msg-1", "msg-7", "msg-100", "msg-2001", "no such id"]


def q_ledger_by_id(spark, sf_dir):
    return ledger.by_id(_ledger(spark, sf_dir), LOOKUP_IDS)


# ----------------------------------------------------------------- "today" views
def q_quarantine_today(spark, sf_dir):
    """The grid of one processing day; rows arrive (and are processed) on their event day here."""
    q = quarantine_rows(_flagged(spark, sf_dir)).withColumn("_silver_processed_at", F.col("event_time"))
    return ledger.quarantine_grid(q, as_of=fx.AS_OF, today_only=True)


def q_failures_today(spark, sf_dir):
    return ledger.failure_list(gold.failure_reason_counts(quarantine_rows(_flagged(spark, sf_dir))), fx.AS_OF,
                               today_only=True)


# ----------------------------------------------------------------- free text (differential oracle)
# Alert phrases and near misses, woven into documents and turns of conversations.
TRAPS = ["Rs.1,234.50 has been debited from account 12345 to VPA a.b@upi BIG SHOP on 12-03-24. UPI ref no: AB12",
         "Donation 12-03-2024 10:11:12 of Rs 55 credited by VPA x@y Some One on 1 May",
         "ATM withdrawal for Rs 900 in PUNE at BRANCH 7 on 31-02-2024 10:00:00. Card ending 4321. Available balance is Rs 7,000.5",
         "spent Rs ,,, at A&B CO. on 3rd; ref# ; USD 5; purchase of Rs. 12.345 using Debit Card ** 9876",
         "Carrs 12 credited; reference number is zz9 NEFT refund $3 on 01-01-2024 23:59:59",
         "no alert here"]


def _woven(text, number):
    """Text with a trap after its first 40 characters."""
    trap = F.element_at(F.array(*map(F.lit, TRAPS)), (number % len(TRAPS) + 1).cast("int"))
    return F.concat(F.substring(text, 1, 40), F.lit(" "), trap, F.lit(" "), text)


def _free_text(spark, sf_dir, name, key, number, sender):
    configure(spark)
    t = fx.table(spark, sf_dir, name)
    stamp = fx.ntz(fx.BRONZE_NOW)
    none = F.lit(None).cast("string")
    landing = t.select(key.alias("id"), none.alias("thread_id"), none.alias("subject"), sender.alias("sender"),
                       none.alias("recipient"), _woven(F.col("text"), number).alias("body"), F.col("text").alias("snippet"),
                       stamp.alias("event_time"), stamp.alias("ingestion_time"))
    return parse_alerts(to_bronze(landing, name, stamp), fx.ntz(fx.SILVER_NOW), PARSE_PARTITIONS).select(
        "id", "bank", "txn_type", "direction", "amount", "currency", "txn_ref", "vpa", "counterparty", "card_last4",
        "account_last4", "location_city", "location_place", "available_balance", "txn_datetime_local",
        reasons_text().alias("reasons"))


def q_parse_documents(spark, sf_dir):
    return _free_text(spark, sf_dir, "documents", F.col("doc_id").cast("string"), F.col("doc_id"), F.col("source"))


def q_parse_conversations(spark, sf_dir):
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _free_text(spark, sf_dir, "conversations", key, F.col("conv_id") + F.col("turn"), F.col("role"))


# ----------------------------------------------------------------- operations
def _recon(spark, sf_dir):
    L = _layers(spark, sf_dir)
    return gold.recon_metrics(L["bronze"], L["silver"], L["silver_quarantine"])


def q_runs_with_recon(spark, sf_dir):
    return ops.runs_with_recon(fx.runs_from_nation(spark, sf_dir), _recon(spark, sf_dir))


def q_runs_fallback(spark, sf_dir):
    return ops.runs_with_recon(None, _recon(spark, sf_dir))


def q_runs_last10(spark, sf_dir):
    """The newest ten runs of the configured jobs."""
    return ops.runs_with_recon(fx.runs_from_nation(spark, sf_dir), _recon(spark, sf_dir), job_ids=[0, 1, 3], latest=10)


def q_quarantine_with_counts(spark, sf_dir):
    q = quarantine_rows(_flagged(spark, sf_dir))
    out = ops.quarantine_with_counts(q, gold.failure_reason_counts(q))
    pair = F.transform("reason_counts", lambda s: F.concat(s["reason"], F.lit(":"),
                                                           s["failure_count"].cast("string")))
    return out.select("id", "event_time", "txn_date", "sender", "amount", "direction",
                      reasons_text().alias("reasons"), F.array_join(pair, ",").alias("reason_counts"))


def q_layer_counts(spark, sf_dir):
    L = _layers(spark, sf_dir)
    L["gold_daily"] = gold.daily_summary(L["silver"])
    L["gold_merchant"] = gold.merchant_summary(L["silver"])
    L["gold_recon"] = gold.recon_metrics(L["bronze"], L["silver"], L["silver_quarantine"])
    L["gold_failures"] = gold.failure_reason_counts(L["silver_quarantine"])
    return ops.layer_counts(L)


# ----------------------------------------------------------------- ingest
def _records(spark, sf_dir):
    configure(spark)
    threads, messages, seen = fx.mail_threads(spark, sf_dir)
    return ingest_messages(threads, messages, seen, NOW_MICROS)


def q_ingest_messages(spark, sf_dir):
    return _records(spark, sf_dir)[0]


def _json_payload(spark, sf_dir):
    """Every message as one JSON record; every 10th cut short, every 15th with a text time."""
    configure(spark)
    _, messages, _ = fx.mail_threads(spark, sf_dir)
    stamp = timestamp_micros(F.lit(NOW_MICROS))
    recs = messages.select("id", "thread_id", "subject", "sender", "recipient", "body",
                           F.substring("body", 1, 200).alias("snippet"),
                           stamp.alias("event_time"), stamp.alias("ingestion_time"),
                           (F.substring_index("id", "-", 1).cast("long") + F.col("turn")).alias("_n"))
    js = records_to_json(recs, keep=["id", "_n"])
    cut = F.col("_n") % 10 == 0
    bad_time = (F.col("_n") % 15 == 0) & ~cut
    value = (F.when(cut, F.expr("substring(value, 1, cast(length(value) / 2 as int))"))
              .when(bad_time, F.regexp_replace("value", r'"event_time":-?[0-9]+', '"event_time":"yesterday"'))
              .otherwise(F.col("value")))
    return js.select(F.col("id").alias("request_id"), value.alias("value"))


def q_json_append(spark, sf_dir):
    return append_json(_json_payload(spark, sf_dir))[0]


def q_json_append_rescued(spark, sf_dir):
    """S5 with rescue: events as records, most with fields that the schema does not have; the layer is written and read back."""
    configure(spark)
    eid = F.col("event_id")
    head = F.concat(F.lit('{"id":"e-'), eid.cast("string"), F.lit('","sender":"'), F.col("event_type"), F.lit('"'))
    value = F.when(eid % 4 == 0, F.concat(head, F.lit("}"))).when(
        eid % 4 == 1, F.concat(head, F.lit(',"props":'), F.col("props"), F.lit("}"))).otherwise(
        F.concat(head, F.lit(',"tags":["a",'), F.col("user_id").cast("string"), F.lit("],"), F.expr("substring(props, 2, length(props))")))
    accepted, _ = append_json(fx.table(spark, sf_dir, "events").select(eid.alias("request_id"), value.alias("value")), rescue=True)
    store = LayerStore(spark, scratch_dir(spark, "rescued"))
    store.append(accepted, "landing")

    def field(path: str, kind: str):
        return F.try_variant_get("rescued", path, kind)

    return store.read("landing").select(
        "request_id", "id", "sender", F.coalesce(field("$.props.k", "long"), field("$.k", "long")).alias("k"),
        field("$.tags[1]", "long").alias("second_tag"), F.col("rescued").isNull().alias("nothing_rescued"))


def q_json_reject(spark, sf_dir):
    return append_json(_json_payload(spark, sf_dir))[1].select("request_id", "reason")


def q_ingest_seen(spark, sf_dir):
    """The ids remembered after two committed runs, the second over a mailbox with nothing new."""
    configure(spark)
    threads, messages, seen = fx.mail_threads(spark, sf_dir)
    store = LayerStore(spark, scratch_dir(spark, "ingest"))
    store.append(seen, "seen", tag="start")
    for run in ("run-1", "run-1", "run-2"):  # the first is delivered twice
        commit_ingest(store, threads, messages, NOW_MICROS, run)
    return store.read("seen")


def _json_bodies(spark, sf_dir):
    """POST bodies: up to four turns of a conversation as a JSON array; bodies of one record are bare objects,
    every 9th body is cut short."""
    one = _json_payload(spark, sf_dir).withColumn("conv", F.substring_index("request_id", "-", 1).cast("long"))
    turn = F.substring_index("request_id", "-", -1).cast("long")
    body = one.filter("NOT value RLIKE '[^}]$'").groupBy("conv", F.floor(turn / 4).alias("part")).agg(
        F.sort_array(F.collect_list("value")).alias("records"))
    text = F.when(F.size("records") == 1, F.col("records")[0]).otherwise(F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")))
    cut = (F.col("conv") + F.col("part")) % 9 == 0
    return body.withColumn("v", text).select(
        F.concat_ws("/", F.col("conv").cast("string"), F.col("part").cast("string")).alias("body_id"),
        F.when(cut, F.expr("substring(v, 1, length(v) - 2)")).otherwise(F.col("v")).alias("value"))


def q_json_body_append(spark, sf_dir):
    return append_json(split_json_array(_json_bodies(spark, sf_dir)))[0].select("body_id", "id", "sender", "body", "event_time")


def q_json_body_reject(spark, sf_dir):
    rejected = append_json(split_json_array(_json_bodies(spark, sf_dir)))[1]
    return rejected.groupBy("body_id", "reason").agg(F.count("*").alias("records"))


# ----------------------------------------------------------------- change feed / mirror

def _pair(spark, sf_dir):
    configure(spark)
    before, after = fx.change_pair(spark, sf_dir)
    return conform(before, SILVER), conform(after, SILVER)


def _bucketed_pair(spark, sf_dir, store):
    """``_pair`` over the ledger committed bucketed by id, and its buckets: every feed and mirror of it is read by them."""
    ledger = conform(_ledger(spark, sf_dir), SILVER)
    buckets = changes.bucket_count(ledger)
    store.write_bucketed(ledger.repartition(buckets, "id"), "ledger", "id", buckets)
    before, after = fx.change_pair(spark, sf_dir, store.read_bucketed("ledger", "id", buckets))
    return conform(before, SILVER), conform(after, SILVER), buckets


def q_change_feed(spark, sf_dir):
    before, after = _pair(spark, sf_dir)
    return changes.change_feed(before, after, "id")


def q_change_feed_digest(spark, sf_dir):
    """S7 in two phases: the versions are kept by month with their digests; months that did not change are not read."""
    from ..operators import digests
    before, after = _pair(spark, sf_dir)
    store = LayerStore(spark, scratch_dir(spark, "digests"))
    by_month = [x.withColumn("_month", F.date_format("effective_date", "yyyy-MM")) for x in (before, after)]
    numbers = [digests.write_digested(store, x, "silver", "_month") for x in by_month]
    feed = digests.changes_between(store, "silver", *numbers, by_month[0].schema)
    return feed.drop("_month").withColumn(changes.SEQ, F.lit(1).cast("long"))


def q_mirror_apply(spark, sf_dir):
    before, after = _pair(spark, sf_dir)
    return changes.apply_changes(before, changes.change_feed(before, after, "id"), "id")


def _three_commits(before, after):
    """The ledger at three commits: changed and deleted rows, then rows that move to another day and merchant."""
    n = F.substring_index("id", "-", -1).cast("long")
    moved = n % 10 == 3
    last = (after.filter(n % 10 != 4)
            .withColumn("event_time", F.when(moved, F.col("event_time") + F.make_dt_interval(F.lit(1))).otherwise(F.col("event_time")))
            .withColumn("vpa", F.when(moved, F.lit(None).cast("string")).otherwise(F.col("vpa"))))
    return before, after, last


def _mirror(spark, sf_dir, view, key):
    """A mirror of ``view(ledger)`` fed with two commits, the first of them delivered again at the end."""
    states = [view(x) for x in _three_commits(*_pair(spark, sf_dir))]
    feeds = [changes.change_feed(states[i], states[i + 1], key, version=i + 1) for i in range(2)]
    store = LayerStore(spark, scratch_dir(spark, "mirror"))
    store.write(changes.mirror_of(states[0]), "mirror")
    for feed in (*feeds, feeds[0]):
        store.write(changes.replay(store.read("mirror"), feed, key), "mirror")
    return changes.visible(store.read("mirror"))


def q_mirror_silver(spark, sf_dir):
    """The mirror of the ledger itself, stored by id as the ledger is; feeds and commits as in ``_mirror``."""
    store = LayerStore(spark, scratch_dir(spark, "mirror"))
    before, after, buckets = _bucketed_pair(spark, sf_dir, store)
    states = _three_commits(before, after)
    feeds = [changes.change_feed(states[i], states[i + 1], "id", version=i + 1, stored=True) for i in range(2)]
    changes.store_mirror(store, "mirror", states[0], "id", buckets)
    for feed in (*feeds, feeds[0]):
        changes.refresh_mirror(store, "mirror", feed, "id", buckets)
    return changes.visible(store.read("mirror"))


def q_mirror_gold_daily(spark, sf_dir):
    return _mirror(spark, sf_dir, gold.daily_summary, list(gold.daily().keys))


def q_mirror_gold_merchant(spark, sf_dir):
    return _mirror(spark, sf_dir, gold.merchant_summary, list(gold.merchant().keys))


def q_mirror_out_of_order(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_mirror_out_of_order(spark, sf_dir)


# ----------------------------------------------------------------- layers with versions and segments
def q_mixed_layer(spark, sf_dir):
    """A refresh, an append without rows, an append, then a replayed append: all rows, each once."""
    configure(spark)
    events = fx.table(spark, sf_dir, "events")
    store = LayerStore(spark, scratch_dir(spark, "mixed"))
    store.append(events.limit(3), "events")  # replaced by the refresh
    store.write(events.filter("event_id % 3 = 0"), "events")
    store.append(events.limit(0), "events", tag="empty")
    for tag in ("one", "two", "two"):
        store.append(events.filter(f"event_id % 3 = {1 if tag == 'one' else 2}"), "events", tag=tag)
    return store.read("events", schema=events.schema)


# ----------------------------------------------------------------- streaming
def q_stream_silver(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_alert_stream_silver(spark, sf_dir)


def q_stream_gold_failures(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_alert_stream_failures(spark, sf_dir)


def q_stream_gold_daily(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_alert_stream_gold(spark, sf_dir, "gold_daily")


def q_stream_gold_merchant(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_alert_stream_gold(spark, sf_dir, "gold_merchant")


def q_stream_restarted(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_restarted_stream(spark, sf_dir)


def q_stream_events_daily(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_events_daily_stream(spark, sf_dir)


def q_stream_dedup(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_events_dedup_stream(spark, sf_dir)


def q_stream_dedup_watermark(spark, sf_dir):
    """Events once by bounded state, and the late ones, each with the layer it is in."""
    from ..streaming import eventtime
    store, schema = eventtime.run_dedup_watermark(spark, sf_dir), fx.table(spark, sf_dir, "events").schema
    once, late = (store.read(name, schema=schema).withColumn("layer", F.lit(name)) for name in ("events_once", "events_late"))
    return once.unionByName(late)


def q_stream_gold_daily_closed(spark, sf_dir):
    from ..streaming import eventtime
    return eventtime.run_closed_days(spark, sf_dir).read("gold_daily_closed")


def q_stream_ledger_late(spark, sf_dir):
    from ..streaming import eventtime
    store = eventtime.run_gate(spark, sf_dir)
    return store.read("ledger_late", schema=_ledger(spark, sf_dir).schema).select(*ledger.LEDGER_COLUMNS)


def q_stream_recon(spark, sf_dir):
    from ..streaming import eventtime
    return eventtime.run_recon_stream(spark, sf_dir, _layers(spark, sf_dir)).read("gold_recon_closed")


def q_upsert_months(spark, sf_dir):
    """J2 on silver kept by month: two commits, the second delivered twice."""
    from ..operators.months import MonthlySilver
    silver = MonthlySilver(spark, scratch_dir(spark, "upsert-months"))
    for split, now, tag in ((0, fx.SILVER_NOW, "one"), (1, fx.SILVER_NOW_2, "two"), (1, fx.SILVER_NOW_2, "two")):
        silver.commit(_silver_run(spark, sf_dir, split, now), tag)
    return silver.read()


def q_stream_progress(spark, sf_dir):
    """Counts of each micro-batch, from the layer that the listener keeps."""
    from ..streaming import progress
    log = progress.run_counted_events(spark, sf_dir).read("stream_progress")
    return log.select("batch_id", "input_rows", F.col("counters")["errors"].alias("errors"), F.col("counters")["users"].alias("users"))


def q_stream_ingest(spark, sf_dir):
    """S4 over the mailbox data source: three growing exports, one checkpoint."""
    from ..streaming import jobs
    return jobs.run_mailbox_stream(spark, sf_dir, NOW_MICROS).read("landing")


def q_stream_mirror(spark, sf_dir):
    from ..streaming import jobs
    return jobs.run_mirror_stream(spark, sf_dir)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
