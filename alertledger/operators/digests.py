"""Change feed in two phases (S7): digests of buckets first, rows only where digests differ.

A version of a table is kept in buckets, one folder each (``bucket`` is any column that the rows have: a month, a
hash of the key). Beside it lies its digest: per bucket the number of rows and two sums over hashes of whole rows,
which need no order and no shuffle of rows. Two versions are compared by their digests alone; only the folders of
buckets that differ are read, and the full outer join of ``change_feed`` runs over them. A row that moves to
another bucket changes both, so both are read and it comes out as an update.

What a comparison costs is the digests (one small row a bucket) and the buckets that changed, not the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import LayerStore
from .changes import change_feed

DIGEST = ["rows", "total", "parity"]


def row_digest(columns: Sequence[str]) -> Column:
    """64-bit hash of a whole row; NULL differs from every value, and so does its place."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(f"`{c}`"), F.col(f"`{c}`").isNull()]
    return F.xxhash64(*parts)


def digests(df: DataFrame, bucket: str) -> DataFrame:
    """bucket, rows, total, parity: one row a bucket, combined in each task before the shuffle."""
    h = row_digest([c for c in df.columns if c != bucket])
    return (df.select(F.col(bucket).cast("string").alias(bucket), h.alias("h")).groupBy(bucket)
            .agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
                 F.bit_xor("h").alias("parity")))


def differing(before: DataFrame, after: DataFrame, bucket: str) -> list[str]:
    """Buckets whose digests differ or that only one side has. Bounded by the number of buckets."""
    a = after.select(F.col(bucket).alias("_other"), *(F.col(c).alias(f"_{c}") for c in DIGEST))
    both = before.join(a, F.col(bucket).eqNullSafe(F.col("_other")), "full_outer")
    same = F.lit(True)
    for c in DIGEST:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return [r[0] for r in both.filter(~same).select(F.coalesce(bucket, "_other")).collect()]


def write_digested(store: LayerStore, df: DataFrame, name: str, bucket: str, tag: str | None = None) -> int:
    """Commit ``df`` as the next version of ``name`` in folders by ``bucket``, and its digest as the same version of ``name_digest``."""
    number = store.write(df.withColumn("_bucket", F.col(bucket).cast("string")).repartition("_bucket"), name, tag=tag, partition_by=["_bucket"])
    written = store.read(name, number, _typed(df))
    store.write(digests(written.select(*df.columns, "_bucket"), "_bucket"), f"{name}_digest", tag=f"{number}")
    return number


def _typed(df: DataFrame):
    return df.withColumn("_bucket", F.lit(None).cast("string")).schema


def changes_between(store: LayerStore, name: str, before: int, after: int, schema, key="id") -> DataFrame:
    """S7 between two digested versions: the feed of ``change_feed`` over the buckets that differ."""
    sides = [store.read_tag(f"{name}_digest", str(v)) for v in (before, after)]
    buckets = differing(*sides, "_bucket")
    full = store.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(None).cast("string")).schema
    parts = []
    for version in (before, after):
        rows = store.read(name, version, full)
        named = [b for b in buckets if b is not None]
        keep = F.col("_bucket").isin(named) if len(named) == len(buckets) else F.col("_bucket").isin(named) | F.col("_bucket").isNull()
        parts.append(rows.filter(keep).drop("_bucket"))
    return change_feed(*parts, key, version=after)
