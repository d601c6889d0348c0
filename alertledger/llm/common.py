"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_dir, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS = 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package (once a Spark application), wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the session's shared folder and read it back.

    This cuts lineage: a lost executor re-reads files, it does not re-run what
    made them, and values that depend on row order stay fixed.
    """
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_dir(spark, label)
    # rows of long texts go to Python in small batches, so that neither side holds many of them at once
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    before = spark.conf.get(key, usual)
    spark.conf.set(key, min(int(before) or BATCH_ROWS, BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema,
                rows: int = 1000) -> DataFrame:
    """Apply ``fn`` to Arrow batches of at most ``rows`` rows, so that a batch of long texts stays small."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def semi_join(big: DataFrame, keys: DataFrame, on: str | list[str], limit: int = 500_000) -> DataFrame:
    """Rows of ``big`` whose ``on`` is in ``keys`` (stored, a few columns of longs).

    The keys are counted first: up to ``limit`` (4 MB a column) they are sent to every
    executor and ``big`` is not shuffled; beyond that it is a join by shuffle.
    """
    keys = keys.select(on).distinct()
    return big.join(F.broadcast(keys) if keys.count() <= limit else keys, on, "left_semi")


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, share: int = 10_000) -> DataFrame:
    """``rows`` joined with ``groups`` (stored, one row a key, never NULL, with the number of its rows in ``size``).

    Groups of at least a ``share``-th of all rows, at most ``share`` of them, go to every task; the other rows
    are joined by a shuffle in which no key has more. So a key with a third of all rows is no hot task.
    """
    least = max(2, -(-(groups.agg(F.sum(size)).first()[0] or 0) // share))
    large = F.broadcast(groups.filter(F.col(size) >= least))
    rest = rows.join(F.broadcast(groups.filter(F.col(size) >= least).select(*on)), on, "left_anti")
    return rows.join(large, on).unionByName(rest.join(groups.filter(F.col(size) < least), on))


def numbered(df: DataFrame, group: str, deal: list, order: list, label: str, keep: list) -> DataFrame:
    """``keep`` columns of ``df`` (stored), ``_place`` of the row in its group (from 1, by ``order``) and ``_rows`` of the group.

    Rows are dealt by ranges of (group, ``deal``), which must agree with ``order``; so a group of any size is in many
    tasks. Ids that grow in that order give a row its place in its part of the group, counts of parts the rest.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, group, *deal).sortWithinPartitions(group, *order)
    rows = stored(dealt.select(*keep, F.monotonically_increasing_id().alias("_seq"), F.spark_partition_id().alias("_part")), label)
    parts = rows.groupBy(group, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select(group, "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - 1).alias("_first"),
                                F.sum("_n").over(of_group).alias("_rows")), f"{label}-parts")
    return rows.join(parts, [group, "_part"]).select(*rows.columns[:-2], (F.col("_seq") - F.col("_first")).alias("_place"), "_rows")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (smallest node reachable) of the nodes of ``edges`` (a, b longs).

    Each round every node takes the smallest component among its own and its neighbours', then the component
    of that component, so the rounds grow with the logarithm of the longest chain. Only minima by key are
    shuffled, so a node with very many neighbours is no hot task.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), label)
    now = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    now = stored(now.withColumn("was", F.col("node")), label)
    while not now.filter("component <> was").isEmpty():
        here = now.select("node", "component")
        heard = both.join(here, both["b"] == here["node"]).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        own = here.select("node", "component", F.col("component").alias("was"))
        least = heard.union(own).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        up = here.select(F.col("node").alias("c"), F.col("component").alias("up"))
        now = stored(least.join(up, least["component"] == up["c"])
                     .select("node", F.least("component", "up").alias("component"), "was"), label)
    return now.select("node", "component")
