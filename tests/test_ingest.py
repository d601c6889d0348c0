"""Mailbox ingest (S4, J7) and schema-enforced JSON append."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from alertledger.session import scratch_dir
from alertledger.sources import export, fixtures as fx
from alertledger.sources.ingest import append_json, ingest_messages, records_to_json, split_json_array

SF_SMALL = "/root/testdata/sf0.001"

NOW = 996_710_400_000_000


def test_ingest_remembers_ids_and_goes_quiet(spark):
    threads, messages, seen = fx.mail_threads(spark, SF_SMALL)
    records, seen2 = ingest_messages(threads, messages, seen, NOW)
    n = records.count()
    assert n > 0
    assert records.filter(F.col("id").isin([r.id for r in seen.collect()])).count() == 0
    assert records.first()["event_time"] == dt.datetime(2001, 8, 2)
    assert all(len(r.snippet) <= 200 for r in records.select("snippet").collect())
    again, seen3 = ingest_messages(threads, messages, seen2, NOW)
    assert again.count() == 0                          # nothing new → no output
    assert seen3.distinct().count() == seen2.distinct().count()


def test_json_round_trip_and_array_payload(spark):
    threads, messages, seen = fx.mail_threads(spark, SF_SMALL)
    records, _ = ingest_messages(threads, messages, seen, NOW)
    texts = [r.value for r in records_to_json(records).collect()]
    payload = spark.createDataFrame([(json.dumps([json.loads(t) for t in texts]),)], "value string")
    ok, bad = append_json(split_json_array(payload))
    assert bad.count() == 0
    got = sorted(tuple(r) for r in ok.collect())
    want = sorted(tuple(r) for r in records.collect())
    assert got == want


def test_every_body_is_counted(spark):
    good = '{"id":"a","event_time":5,"ingestion_time":5}'
    bodies = [(1, f"[{good},{good}]"), (2, good), (3, f"[{good},"), (4, "[]"), (5, "{}"), (6, '{"id":"x","extra":1}'),
              (7, "not json"), (8, '[{"id":"c","event_time":"soon"}, 5]'), (9, None)]
    ok, bad = append_json(split_json_array(spark.createDataFrame(bodies, "body int, value string")))
    assert sorted(r.body for r in ok.collect()) == [1, 1, 2]
    assert sorted((r.body, r.reason) for r in bad.collect()) == [
        (3, "malformed"), (5, "empty_record"), (6, "unknown_field"), (7, "malformed"), (8, "malformed"),
        (8, "schema_mismatch"), (9, "malformed")]


def test_csv_keeps_every_cell(spark):
    rows = [(1, "line one\nline two\r\n", dt.datetime(2024, 1, 1, 2, 3, 4, 567891)), (2, "", None), (3, None, None),
            (4, ' a "quoted", \\ cell ', dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "i int, t string, at timestamp_ntz")
    path = export.export_csv(df, scratch_dir(spark, "test-csv"))
    assert sorted(tuple(r) for r in export.read_csv(spark, path, df.schema).collect()) == rows


def test_ids_twice_in_one_run_are_sent_once(spark):
    threads = spark.createDataFrame([("t", "ALERT", True)], "thread_id string, label string, is_unread boolean")
    one = ("m1", "t", "s", "a", "b", "text")
    messages = spark.createDataFrame([one, one], "id string, thread_id string, subject string, sender string, recipient string, body string")
    records, _ = ingest_messages(threads, messages, spark.createDataFrame([], "id string"), NOW)
    assert records.count() == 1


def test_json_rejects(spark):
    good = '{"id":"a","event_time":5,"ingestion_time":5}'
    raw = spark.createDataFrame([(1, good), (2, good[:15]), (3, '{"id":"c","event_time":"soon"}')],
                                "request_id int, value string")
    ok, bad = append_json(raw)
    assert [r.request_id for r in ok.collect()] == [1]
    assert {r.request_id: r.reason for r in bad.collect()} == {2: "malformed", 3: "schema_mismatch"}


def test_rescued_fields_keep_types_and_the_rest_is_rejected_as_before(spark):
    raw = spark.createDataFrame([(1, '{"id":"a","x":{"y":[1,null]},"p":2.5}'), (2, '{"id":"b"}'), (3, "{}"), (4, '{"x":'),
                                 (5, '{"id":"c","event_time":"late","x":1}'), (6, '{"x":null}')], "n int, value string")
    ok, bad = append_json(raw, rescue=True)
    found = {r["n"]: r["rescued"].toJson() if r["rescued"] is not None else None for r in ok.collect()}
    assert found == {1: '{"p":2.5,"x":{"y":[1,null]}}', 2: None, 6: '{"x":null}'}
    assert {r["n"]: r["reason"] for r in bad.collect()} == {3: "empty_record", 4: "malformed", 5: "schema_mismatch"}
    strict = {r["n"]: r["reason"] for r in append_json(raw)[1].collect()}
    assert strict == {1: "unknown_field", 3: "empty_record", 4: "malformed", 5: "unknown_field", 6: "unknown_field"}
