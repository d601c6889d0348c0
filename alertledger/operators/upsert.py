"""Newest row per key (N1) and the SCD-1 upsert into silver.

Both are one hash shuffle on the key. ``row_number() == 1`` over a key window
is planned by Spark as a *partial* group limit before the exchange and a final
one after it, so a key that holds a third of all rows still ships at most one
row per map task — the hot key never lands in one reducer in full.

The upsert is a union of target and source followed by the same window: a
source row replaces the target row only when its ``event_time`` is strictly
newer; ties keep the target. That is MERGE's matched/not-matched logic without
a join, so neither side is shuffled twice and no key pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import effective_ts
from ..schemas import SILVER, conform

_ORIGIN = "_origin"   # 0 = current target row, 1 = incoming source row
_RN = "_rn"
_HELPERS = (_ORIGIN,)


def row_hash(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """Deterministic last-resort tie-break over every data column."""
    return F.xxhash64(*[F.col(c) for c in df.columns if c not in exclude and c not in _HELPERS])


def newest_per_key(df: DataFrame, key: str | Sequence[str] = "id",
                   order: Sequence[Column] | None = None) -> DataFrame:
    """Keep one row per key, newest ``event_time`` first.

    Ties (which the reference leaves to chance) fall to the newest
    ``ingestion_time`` and then to a row hash, so reruns agree.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if order is None:
        order = [F.col("event_time").desc_nulls_last()]
        if "ingestion_time" in df.columns:
            order.append(F.col("ingestion_time").desc_nulls_last())
    order = list(order) + [row_hash(df).desc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def to_silver(clean: DataFrame) -> DataFrame:
    """Clean parsed rows → silver layout (raw text and reasons dropped, F2 materialised)."""
    eff = effective_ts()
    with_eff = clean.withColumn("effective_ts", eff).withColumn("effective_date", F.to_date(eff))
    return conform(with_eff, SILVER)


def upsert(target: DataFrame | None, source: DataFrame, key: str = "id") -> DataFrame:
    """SCD-1 upsert of ``source`` into ``target`` by ``key``.

    * key only in source → newest source row is inserted (first run: target None);
    * key in both → replaced by the newest source row iff its event_time is
      strictly greater than the target's (a NULL target time is never replaced);
    * key only in target → kept. Nothing is ever deleted.
    """
    src = conform(source, SILVER) if set(SILVER.fieldNames()) <= set(source.columns) else to_silver(source)
    if target is None:
        return newest_per_key(src, key)
    tgt = conform(target, SILVER)
    both = tgt.withColumn(_ORIGIN, F.lit(0)).unionByName(src.withColumn(_ORIGIN, F.lit(1)))
    pinned = F.when((F.col(_ORIGIN) == 0) & F.col("event_time").isNull(), 1).otherwise(0)
    order = [
        pinned.desc(),                                 # target with NULL time: never replaced
        F.col("event_time").desc_nulls_last(),         # strictly newer wins ...
        F.col(_ORIGIN).asc(),                          # ... and on a tie the target stays
        F.col("ingestion_time").desc_nulls_last(),
    ]
    return newest_per_key(both, key, order).drop(_ORIGIN)


def upsert_bucketed(target: DataFrame, source: DataFrame, buckets: int, key: str = "id") -> DataFrame:
    """J2 for a silver table stored bucketed by ``key`` into ``buckets`` buckets.

    Same result as ``upsert`` (same MERGE rule and tie-breaks), planned so that
    the large side is never shuffled: the incoming rows are reduced to the
    newest row per key (a group limit on both sides of that exchange, so a hot
    key stays cheap), hashed into the table's bucket layout and merge-joined
    against the bucketed scan, which Spark reads already partitioned by
    ``key``. Cost per commit: two shuffles of the batch and a scan of the
    table. ``buckets`` is the table's own number, chosen by whoever creates it.
    """
    src = conform(source, SILVER) if set(SILVER.fieldNames()) <= set(source.columns) else to_silver(source)
    src = newest_per_key(src, key).repartition(buckets, key)
    there = F.lit(True).alias("_there")
    t, s = conform(target, SILVER).select("*", there).alias("t"), src.select("*", there).alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    in_t, in_s = F.col("t._there").isNotNull(), F.col("s._there").isNotNull()
    newer = F.coalesce(F.col("s.event_time") > F.col("t.event_time"), F.lit(False))
    take_source = in_s & (~in_t | newer)
    return joined.select(*[F.when(take_source, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
                           for c in SILVER.fieldNames()])


def changed_images(target: DataFrame | None, source: DataFrame, key: str = "id", buckets: int | None = None) -> DataFrame:
    """What ``upsert`` of ``source`` into ``target`` changes: old rows with ``sign`` -1, the rows in their place or new with +1.

    With ``buckets`` (the target's own number) the target is read as it is stored, and only the batch is shuffled.
    """
    src = newest_per_key(conform(source, SILVER) if set(SILVER.fieldNames()) <= set(source.columns) else to_silver(source), key)
    if target is None:
        return src.withColumn("sign", F.lit(1))
    src = src if buckets is None else src.repartition(buckets, key)
    t, s = conform(target, SILVER).select("*", F.lit(True).alias("_there")).alias("t"), src.alias("s")
    both = s.join(t, F.col(f"t.{key}") == F.col(f"s.{key}"), "left")
    there = F.col("t._there").isNotNull()
    taken = both.filter(~there | F.coalesce(F.col("s.event_time") > F.col("t.event_time"), F.lit(False)))
    new, old = (F.struct(*(F.col(f"{side}.{c}").alias(c) for c in SILVER.fieldNames()), F.lit(sign).alias("sign")) for side, sign in (("s", 1), ("t", -1)))
    return taken.select(F.explode(F.when(there, F.array(new, old)).otherwise(F.array(new))).alias("image")).select("image.*")
