"""The mailbox data source: batch and stream read the same messages, a restart goes on after its checkpoint."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx, mailbox
from alertledger.sources.store import LayerStore
from alertledger.streaming import jobs

SF_SMALL = "/root/testdata/sf0.001"


def test_batch_reads_every_line(spark, tmp_path):
    mailbox.register(spark)
    _, messages, _ = fx.mail_threads(spark, SF_SMALL)
    path = str(tmp_path / "mail")
    mailbox.export_messages(messages, path, 0)
    with open(os.path.join(path, "zz-odd.json"), "w") as odd:
        odd.write('{"id": "x", "turn": "three", "body": {"a": 1}, "more": 5}\n\nnot json\n[1]\n{"id": "é"}')
    rows = spark.read.format("mailbox").option("path", path).load()
    assert rows.columns == list(mailbox.FIELDS)
    good = rows.filter("raw IS NULL AND subject IS NOT NULL").select(*messages.columns)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, messages.collect()))
    odd = {(r["id"], r["turn"], r["body"], r["raw"]) for r in rows.filter("subject IS NULL").collect()}
    assert odd == {("x", None, '{"a": 1}', None), ("é", None, None, None), (None, None, None, "not json"), (None, None, None, "[1]")}
    assert spark.read.format("mailbox").option("path", str(tmp_path / "none")).load().count() == 0


def test_restart_resumes_and_survives_removed_files(spark):
    mailbox.register(spark)
    root = scratch_dir(spark, "t-mailbox")
    store, batches = LayerStore(spark, f"{root}/layers"), []

    def run():
        stream = spark.readStream.format("mailbox").option("path", f"{root}/export").load()
        jobs.run_once(stream, lambda batch, tag: batches.append(sorted(r["id"] for r in batch.collect())), f"{root}/_checkpoint")

    _, messages, _ = fx.mail_threads(spark, SF_SMALL)
    n = F.pmod(F.xxhash64("id"), F.lit(3))
    for i in range(3):
        mailbox.export_messages(messages.filter(n == i), f"{root}/export", i)
        run()
        run()  # nothing new
        fs, path = store._fs, store._Path(f"{root}/export/export={i:06d}")
        fs.delete(path, True)
    want = [sorted(r["id"] for r in messages.filter(n == i).collect()) for i in range(3)]
    assert [b for b in batches if b] == want
