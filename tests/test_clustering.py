"""Z-ordered silver: a filter on date alone and one on merchant alone both skip most row groups."""

from __future__ import annotations

import glob
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from alertledger.operators import clustering
from alertledger.session import scratch_dir
from alertledger.sources import fixtures as fx
from alertledger.sources.store import LayerStore

SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def clustered(spark):
    store, ledger = LayerStore(spark, scratch_dir(spark, "t-zorder")), fx.ledger_orders(spark, SF_MID)
    clustering.write_clustered(ledger, store)
    return store, ledger


def groups(store, column):
    """(smallest, largest) of a column in every row group."""
    out = []
    for path in glob.glob(f"{store.root.removeprefix('file:')}/silver_clustered/v=*/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            stats = next(group.column(j).statistics for j in range(group.num_columns) if group.column(j).path_in_schema == column)
            out.append((stats.min, stats.max))
    return out


def test_both_filters_skip_most_row_groups(spark, clustered):
    store, ledger = clustered
    dates, keys = groups(store, "effective_date"), groups(store, clustering.MERCHANT_KEY)
    assert len(dates) >= 48
    week = (date(1998, 3, 2), date(1998, 3, 8))
    assert sum(a <= week[1] and b >= week[0] for a, b in dates) <= len(dates) / 4
    key = spark.range(1).select(clustering.merchant_key(F.lit("SHOP 7"))).first()[0]
    assert sum(a <= key <= b for a, b in keys) <= len(keys) / 4


def test_rows_are_the_same(spark, clustered):
    store, ledger = clustered
    rows = store.read("silver_clustered")
    for merchant in ("SHOP 7", "", None, "no such shop"):
        found = clustering.of_merchant(rows, merchant).select(*ledger.columns)
        want = ledger.filter(F.col("counterparty").eqNullSafe(F.lit(merchant).cast("string")))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert rows.count() == ledger.count()
    plan = clustering.of_merchant(rows, "SHOP 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(merchant_key," in plan


def test_no_rows_and_no_dates(spark):
    store = LayerStore(spark, scratch_dir(spark, "t-zorder-none"))
    ledger = fx.ledger_orders(spark, SF_MID)
    clustering.write_clustered(ledger.limit(0), store, "none")
    undated = ledger.limit(5).withColumn("effective_date", F.lit(None).cast("date"))
    clustering.write_clustered(undated, store, "undated", files=2)
    assert store.read("none", schema=ledger.schema).count() == 0 and store.read("undated").count() == 5
