"""Deep pages of the ledger by an order-statistics index.

The index is a copy of the ledger in page order: dealt by ranges of the order, sorted inside each range, one folder
a range, and beside it the number of rows of each range and of all ranges before it. Each row has its position in
its folder, and every ``rows_per_part`` rows are a page of the file with its own smallest and largest position. Page N
of the ledger is then around row N x size: of one or two folders the file pages with these positions are read,
whatever N is, where an offset over the ledger reads and orders everything before the page. Small parts share a
folder, so tasks, range bounds and folders follow the rows (``ROWS_PER_FOLDER``), not the number of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.store import LayerStore
from .ledger import LEDGER_COLUMNS, newest_first, with_effective

PART = "_part"  # the folder
POSITION = "_position"  # of a row in its folder, from 0
ROWS_PER_FOLDER = 250_000  # at least, where parts are smaller and there are more than MIN_FOLDERS
MIN_FOLDERS = 16


def build_page_index(silver: DataFrame, store: LayerStore, name: str = "ledger_pages", rows_per_part: int = 1_000_000,
                     tag: str | None = None) -> int:
    """Commit the index of ``silver``: layers ``name`` (rows by folder) and ``name_parts`` (folder, rows, before)."""
    rows = with_effective(silver).select(*LEDGER_COLUMNS)
    total = silver.count()
    folders = min(max(1, -(-total // rows_per_part)), max(MIN_FOLDERS, -(-total // ROWS_PER_FOLDER)))
    dealt = (rows.repartitionByRange(folders, *newest_first(rows)).withColumn(PART, F.spark_partition_id())
             .sortWithinPartitions(PART, *newest_first(rows)))
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number of the row in its task
    number = store.write(dealt.withColumn(POSITION, in_task), name, tag=tag, partition_by=[PART],
                         options={"parquet.page.row.count.limit": str(rows_per_part)})
    counts = store.read(name, number, _with_part(rows.schema)).groupBy(PART).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a folder, not a row of the ledger
    store.write(counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), f"{name}_parts", tag=str(number))
    return number


def _with_part(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(POSITION, LongType()), StructField(PART, IntegerType())])


def indexed_page(store: LayerStore, page: int, size: int, schema: StructType, name: str = "ledger_pages") -> DataFrame:
    """Page ``page`` (0-based) of the newest index, newest first. Reads the file pages that it lies in."""
    version, first = store.current_version(name), page * size
    parts = store.read_tag(f"{name}_parts", str(version))
    hit = parts.filter((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first)).collect()  # at most size folders with rows
    wanted = F.lit(False)
    for r in hit:
        wanted = wanted | ((F.col(PART) == r[PART]) & F.col(POSITION).between(first - r["before"], first + size - 1 - r["before"]))
    lowest = min((max(first - r["before"], 0) for r in hit), default=0)  # positions alone, for the scan
    highest = max((min(first + size - r["before"], r["rows"]) for r in hit), default=0)
    rows = store.read(name, version, _with_part(schema)).filter(
        F.col(PART).isin([r[PART] for r in hit]) & F.col(POSITION).between(lowest, highest) & wanted)
    return rows.drop(PART, POSITION).orderBy(*newest_first(rows))


def page_schema(silver: DataFrame) -> StructType:
    return with_effective(silver).select(*LEDGER_COLUMNS).schema
