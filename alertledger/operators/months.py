"""Silver kept by month of its effective date: a commit rewrites only the months that it touches.

``rows/month=2001-07/`` holds the rows, ``keys/bucket=17/`` the (id, month, event_time) of every row by hash of
the id. A commit looks its ids up in the key buckets that they fall into, reads the old images from the months
that these name, and overwrites the touched months and key buckets (dynamic partition overwrite); everything else
is neither read nor written. What it changed stays as signed images (-1 the old row, +1 the new one), which
roll-ups by deltas (``gold.RollUp.apply``) follow without reading silver.

A commit is idempotent by its tag: the images are stored before anything is overwritten, and a commit that died
half-way is done again from them. Until then readers may see some months new and some old.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import SILVER, conform
from ..sources.store import LayerStore
from .upsert import newest_per_key, to_silver

MONTH, BUCKET, SIGN = "month", "bucket", "sign"
NO_MONTH = "none"  # of rows without any date
SORT = ["effective_date", "effective_ts"]


def month_of() -> Column:
    return F.coalesce(F.date_format("effective_date", "yyyy-MM"), F.lit(NO_MONTH))


class MonthlySilver:
    """``buckets``: of the key layer; a batch reads and rewrites those its ids fall into. ``files``: of a month, about."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, files: int = 1):
        self.spark, self.root, self.buckets, self.files = spark, root.rstrip("/"), buckets, files
        self.log = LayerStore(spark, f"{self.root}/log")
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SILVER.fields)
        self._images = f"{names}, {MONTH} string, {SIGN} int"
        self._rows = f"{names}, {MONTH} string"
        self._keys = f"id string, {MONTH} string, event_time timestamp_ntz, {BUCKET} int"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _part(self, name: str, schema: str, column: str, values: list) -> DataFrame:
        """The partitions ``values`` of a layer: the filter is on the partition column, so only their files are listed and read."""
        fs, path = self._fs(f"{self.root}/{name}")
        if not values or not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").filter(F.col(column).isin(values))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self._rows).parquet(f"{self.root}/rows").select(*SILVER.fieldNames())

    def rows(self) -> DataFrame:
        """Silver with its ``month``, for readers that want whole months only."""
        return self.spark.read.schema(self._rows).parquet(f"{self.root}/rows")

    def images(self, tag: str) -> DataFrame:
        """What the commit ``tag`` changed: silver rows with ``sign`` -1 (before) or +1 (after)."""
        return self.log.read_tag("images", tag, self.spark.createDataFrame([], self._images).schema)

    def commit(self, clean: DataFrame, tag: str) -> DataFrame:
        """Upsert of ``clean`` (parsed or silver rows; newest event_time wins, a tie keeps the stored row); returns the images."""
        if not self.log.has_tag("images", tag):
            self.log.append(self._changed(clean, tag), "images", tag=tag)
        images = self.images(tag)
        if not self.log.has_tag("done", tag):
            self._overwrite(images)
            self.log.append(self.spark.range(1), "done", tag=tag)
        return images

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _changed(self, clean: DataFrame, tag: str) -> DataFrame:
        """Signed images of the rows that ``clean`` inserts or replaces."""
        there = set(SILVER.fieldNames()) <= set(clean.columns)
        newest = newest_per_key(conform(clean, SILVER) if there else to_silver(clean)).withColumn(MONTH, month_of())
        self.log.append(newest, "incoming", tag=tag)
        incoming = self.log.read_tag("incoming", tag, newest.schema)
        buckets = [r[0] for r in incoming.select(self._bucket().alias(BUCKET)).distinct().collect()]
        known = (self._part("keys", self._keys, BUCKET, buckets)
                 .select("id", F.col(MONTH).alias("_month"), F.col("event_time").alias("_time"), F.lit(True).alias("_known")))
        newer = F.col("_known").isNull() | F.coalesce(F.col("event_time") > F.col("_time"), F.lit(False))
        taken = incoming.join(known, "id", "left").filter(newer)
        moved = [r[0] for r in taken.filter("_known").select("_month").distinct().collect()]
        after = taken.select(*incoming.columns).withColumn(SIGN, F.lit(1))
        if not moved:
            return after
        old = self._part("rows", self._rows, MONTH, moved).join(taken.select("id"), "id", "left_semi")
        return old.select(*incoming.columns).withColumn(SIGN, F.lit(-1)).unionByName(after)

    def _overwrite(self, images: DataFrame) -> None:
        """The touched months without the old images, with the new ones; the keys of the new ones. Two independent jobs."""
        new = images.filter(F.col(SIGN) == 1).drop(SIGN)
        ids = images.select("id").distinct()
        is_new = F.col(SIGN) == 1
        touched = images.agg(*(F.collect_set(c) for c in (  # bounded by the months and buckets there are
            F.col(MONTH), F.when(is_new, F.col(MONTH)), F.when(is_new, self._bucket())))).first()
        months, into, buckets = map(sorted, touched)
        if not months:
            return
        kept = self._part("rows", self._rows, MONTH, months).join(ids, "id", "left_anti")
        left = sorted(set(months) - set(into))  # rows only left these
        empty = set(left) - {r[0] for r in kept.filter(F.col(MONTH).isin(left)).select(MONTH).distinct().collect()} if left else set()
        spread = F.pmod(F.xxhash64("id"), F.lit(self.files))  # a month with a third of all rows is several tasks and files
        rows = kept.unionByName(new).repartition(MONTH, spread).sortWithinPartitions(MONTH, *SORT)
        keyed = new.select("id", MONTH, "event_time", self._bucket().alias(BUCKET))
        others = self._part("keys", self._keys, BUCKET, buckets).join(ids, "id", "left_anti")
        keys = others.unionByName(keyed).repartition(BUCKET)
        with ThreadPoolExecutor(2) as pool:
            jobs = [pool.submit(self._replace, rows, "rows", MONTH), pool.submit(self._replace, keys, "keys", BUCKET)]
            for job in jobs:
                job.result()
        for month in empty:  # an overwrite by rows cannot empty a partition
            fs, path = self._fs(f"{self.root}/rows/{MONTH}={month}")
            fs.delete(path, True)

    def _replace(self, rows: DataFrame, name: str, column: str) -> None:
        """Overwrite the partitions that ``rows`` has. Spark moves the new files in once all of them are written."""
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column)
         .parquet(f"{self.root}/{name}"))
