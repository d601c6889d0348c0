"""Silver by month rewrites only what a commit touches; gold by deltas equals gold from scratch."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from alertledger.operators import gold
from alertledger.operators.months import MonthlySilver
from alertledger.operators.upsert import changed_images, upsert
from alertledger.schemas import SILVER, conform
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def ledger(spark):
    return conform(fx.ledger_orders(spark, SF_SMALL), SILVER)


def files(root):
    """Month and file of every data file with its time of change."""
    out = {}
    for folder, _, names in os.walk(root.removeprefix("file:")):
        for name in names:
            if name.endswith(".parquet"):
                out[os.path.join(folder, name)] = os.stat(os.path.join(folder, name)).st_mtime_ns
    return out


def rows(df):
    return sorted(map(tuple, df.select(*SILVER.fieldNames()).collect()), key=repr)


def moved(df):
    """Later times for a few rows, three of them in another month."""
    later = F.col("event_time") + F.make_dt_interval(F.lit(1))
    n = F.substring_index("id", "-", -1).cast("long")
    return (df.withColumn("event_time", later).withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)"))
            .withColumn("effective_date", F.when(n % 2 == 0, F.lit("2001-07-09").cast("date")).otherwise(F.col("effective_date"))))


def test_commit_rewrites_touched_months_only(spark):
    silver = MonthlySilver(spark, scratch_dir(spark, "t-months"), buckets=16, files=2)
    first = ledger(spark)
    silver.commit(first, "one")
    before = files(f"{silver.root}/rows")
    batch = moved(first.filter("effective_date BETWEEN '1997-03-01' AND '1997-03-31'"))
    images = silver.commit(batch, "two")
    after = files(f"{silver.root}/rows")
    changed = {path.split("month=")[1][:7] for path, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"1997-03", "2001-07"}
    assert rows(silver.read()) == rows(upsert(first, batch))
    assert rows(silver.commit(batch, "two").drop("sign", "month")) == rows(images.drop("sign", "month"))
    assert rows(silver.read()) == rows(upsert(first, batch))
    older = batch.withColumn("event_time", F.col("event_time") - F.make_dt_interval(F.lit(9)))
    assert silver.commit(older, "three").count() == 0 and files(f"{silver.root}/rows") == after


def test_a_month_that_loses_its_last_row_goes_and_a_dead_commit_is_done_again(spark):
    silver = MonthlySilver(spark, scratch_dir(spark, "t-empty"), buckets=4)
    one = ledger(spark).filter("effective_date < '1995-03-01'")
    silver.commit(one, "one")
    batch = one.filter("effective_date < '1995-02-01'").withColumn("event_time", F.col("event_time") + F.make_dt_interval(F.lit(1))).withColumn(
        "effective_date", F.lit("1999-09-09").cast("date"))
    overwrite, calls = silver._replace, []

    def dies(rows, name, column):
        calls.append(name)
        if name == "keys":
            raise OSError("lost")
        overwrite(rows, name, column)
    silver._replace = dies
    try:
        silver.commit(batch, "two")
    except OSError:
        pass
    silver._replace = overwrite
    silver.commit(batch, "two")
    assert "keys" in calls and rows(silver.read()) == rows(upsert(one, batch))
    assert {r["month"] for r in silver.rows().select("month").distinct().collect()} == {"1995-02", "1999-09"}


def test_gold_by_deltas_equals_gold_from_scratch(spark):
    rng = random.Random(3)
    silver, tables = ledger(spark).filter("id LIKE '%1'"), {}
    for step in range(4):
        shift = rng.choice([-3, 1, 2])
        n = F.substring_index("id", "-", -1).cast("long")
        batch = silver.filter(n % 3 == step % 3) if step else silver
        if step:
            batch = (batch.withColumn("event_time", F.col("event_time") + F.make_dt_interval(F.lit(shift)))
                     .withColumn("amount", (F.col("amount") * rng.choice([2, 1]) + step).cast("decimal(18,2)"))
                     .withColumn("counterparty", F.when(n % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("counterparty"))))
        target = silver if step else None
        images = changed_images(target, batch)
        silver = spark.createDataFrame(upsert(target, batch).collect(), SILVER)
        for name, roll_up in (("daily", gold.daily()), ("merchant", gold.merchant())):
            applied = spark.createDataFrame((a := roll_up.apply(tables.get(name), images)).collect(), a.schema)
            tables[name] = spark.createDataFrame((f := roll_up.finish(applied, silver)).collect(), f.schema)
            want = roll_up.summary(roll_up.keyed(silver))
            assert tables[name].schema.simpleString() == want.schema.simpleString()
            assert sorted(map(repr, tables[name].collect())) == sorted(map(repr, want.collect())), (step, name)


def test_silver_is_not_scanned_for_deltas(spark, tmp_path):
    path = str(tmp_path / "silver")
    ledger(spark).write.parquet(path)
    stored = spark.read.parquet(path)
    images = changed_images(None, ledger(spark).limit(5))
    plan = gold.daily().apply(gold.daily_summary(ledger(spark)), images)._jdf.queryExecution().executedPlan().toString()
    assert path not in plan
    assert gold.daily().finish(spark.createDataFrame((a := gold.daily().apply(None, images)).collect(), a.schema), stored).count() == len(
        gold.daily_summary(images).collect())


def test_empty_and_unseen(spark):
    silver = MonthlySilver(spark, scratch_dir(spark, "t-none"))
    assert silver.commit(ledger(spark).limit(0), "none").count() == 0
    silver.commit(ledger(spark).limit(3), "three")
    assert silver.read().count() == 3
