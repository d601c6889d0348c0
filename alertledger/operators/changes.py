"""Row-change feed (S7) and its replay into serving copies.

Keys are one column or several, and NULL is a key value like any other (a
merchant without VPA). ``change_feed`` keeps one row per key on each side, then
joins the two sides on the keys. The NULL-safe join hashes other expressions
than the window, so Spark plans two exchanges per side. Of sides that are stored
bucketed by one key (``stored``) the rows with a key meet by plain equality: the
window and the join use the buckets, and only rows without a key are shuffled.

A mirror keeps the commit version of each row's last change, and deleted rows
as markers. A change is taken only if its version is newer than what the mirror
has for the key, so a feed may be replayed, or arrive late or out of order.
``visible`` is what readers of the mirror see. A mirror kept bucketed by its key
(``store_mirror``, ``refresh_mirror``) is read as it is stored, so a refresh
shuffles the feed only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import LayerStore
from .upsert import row_hash

CHANGE = "_change_type"   # insert | update | delete
SEQ = "_commit_version"
DELETED = "_deleted"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(row_hash(df).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def change_feed(before: DataFrame, after: DataFrame, key: str | Sequence[str] = "id",
                compare: Sequence[str] | None = None, version: int = 1, stored: bool = False) -> DataFrame:
    """Insert / update / delete rows turning ``before`` into ``after``.

    Insert and update rows carry the after image, delete rows the before
    image; unchanged rows are not emitted. Equality is NULL-safe per column.
    ``stored``: both sides are read bucketed by ``key``, into the same number of buckets.
    """
    if stored:
        keyed, keyless = ([side.filter(cond) for side in (before, after)] for cond in (F.col(key).isNotNull(), F.col(key).isNull()))
        return (_feed(*keyed, key, compare, version, Column.__eq__)
                .unionByName(_feed(*keyless, key, compare, version, Column.eqNullSafe)))
    return _feed(before, after, key, compare, version, Column.eqNullSafe)


def _feed(before: DataFrame, after: DataFrame, key: str | Sequence[str], compare: Sequence[str] | None, version: int,
          equal: Callable[[Column, Column], Column]) -> DataFrame:
    cols, keys = after.columns, _keys(key)
    compare = [c for c in (compare or cols) if c not in keys]
    b = _one_per_key(before.select(*cols), keys).withColumn("_there", F.lit(True)).alias("b")
    a = _one_per_key(after.select(*cols), keys).withColumn("_there", F.lit(True)).alias("a")
    match = [equal(F.col(f"b.`{k}`"), F.col(f"a.`{k}`")) for k in keys]
    joined = b.join(a, match, "full_outer")
    in_b, in_a = F.col("b._there").isNotNull(), F.col("a._there").isNotNull()
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"b.`{c}`").eqNullSafe(F.col(f"a.`{c}`"))
    kind = (F.when(in_a & ~in_b, F.lit("insert"))
             .when(in_b & ~in_a, F.lit("delete"))
             .when(~same, F.lit("update")))
    image = [F.when(in_a, F.col(f"a.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c) for c in cols]
    return (joined.select(*image, kind.alias(CHANGE))
            .filter(F.col(CHANGE).isNotNull())
            .withColumn(SEQ, F.lit(version).cast("long")))


def mirror_of(snapshot: DataFrame, version: int = 0) -> DataFrame:
    """A mirror that starts as ``snapshot``, the state at commit ``version``."""
    return snapshot.withColumn(SEQ, F.lit(version).cast("long")).withColumn(DELETED, F.lit(False))


def replay(mirror: DataFrame, feed: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """The mirror after ``feed``; per key the change of the highest commit version wins, a tie keeps the mirror."""
    changes = feed.withColumn(DELETED, F.col(CHANGE) == "delete").select(*mirror.columns)
    both = mirror.withColumn("_mine", F.lit(1)).unionByName(changes.withColumn("_mine", F.lit(0)))
    w = Window.partitionBy(*_keys(key)).orderBy(F.col(SEQ).desc(), F.col("_mine").desc(), F.col(DELETED).asc())
    return (both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select(*mirror.columns))


def replay_stored(mirror: DataFrame, feed: DataFrame, key: str, buckets: int) -> DataFrame:
    """``replay`` into a mirror that is read bucketed by ``key``: the feed is hashed into its ``buckets``, the mirror stays."""
    keyed, keyless = F.col(key).isNotNull(), F.col(key).isNull()
    changes = feed.filter(keyed).repartition(buckets, key).withColumn(DELETED, F.col(CHANGE) == "delete").select(*mirror.columns)
    last = Window.partitionBy(key).orderBy(F.col(SEQ).desc(), F.col(DELETED).asc())
    m, c = (side.withColumn("_there", F.row_number().over(last)).filter(F.col("_there") == 1).alias(name)
            for side, name in ((mirror.filter(keyed), "m"), (changes, "c")))
    newer = F.col("m._there").isNull() | F.coalesce(F.col(f"c.{SEQ}") > F.col(f"m.{SEQ}"), F.lit(False))
    replayed = m.join(c, F.col(f"m.`{key}`") == F.col(f"c.`{key}`"), "full_outer").select(
        *(F.when(newer, F.col(f"c.`{x}`")).otherwise(F.col(f"m.`{x}`")).alias(x) for x in mirror.columns))
    return replayed.unionByName(replay(mirror.filter(keyless), feed.filter(keyless), key))


ROWS_PER_BUCKET = 250_000  # a bucket is sorted in one task's memory


def bucket_count(rows: DataFrame) -> int:
    """Buckets for a layer of so many rows: as many more as the layer is larger."""
    return max(8, -(-rows.count() // ROWS_PER_BUCKET))


def store_mirror(store: LayerStore, name: str, snapshot: DataFrame, key: str, buckets: int) -> None:
    """Commit a mirror that starts as ``snapshot``, bucketed by ``key``."""
    store.write_bucketed(mirror_of(snapshot), name, key, buckets)


def refresh_mirror(store: LayerStore, name: str, feed: DataFrame, key: str, buckets: int, tag: str | None = None) -> None:
    """S8 on a mirror stored by ``store_mirror``: the next version, after ``feed``."""
    store.write_bucketed(replay_stored(store.read_bucketed(name, key, buckets), feed, key, buckets), name, key, buckets, tag=tag)


def visible(mirror: DataFrame) -> DataFrame:
    return mirror.filter(~F.col(DELETED)).drop(SEQ, DELETED)


def apply_changes(snapshot: DataFrame, feed: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """S8 in one step: a snapshot (commit 0) brought up to date by ``feed``."""
    return visible(replay(mirror_of(snapshot), feed, key))
