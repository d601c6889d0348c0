"""Silver clustered by date and merchant at once.

Sorted by date, a file of the ledger has a tight range of dates and every merchant; sorted by merchant, the other
way round. Here the place of the date in its range and a hash of the merchant are cut to 16 bits each and
interleaved (a Z-order key); rows are dealt by ranges of that key and sorted by it, so each row group has a tight
range of both, and the scan skips row groups for a filter on either. The hash is kept as the column
``merchant_key``, because statistics of merchant names say nothing about an order by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import LayerStore

MERCHANT_KEY = "merchant_key"
BITS = 16


def merchant_key(name: Column) -> Column:
    """Hash of a merchant in 16 bits; NULL is a merchant of its own."""
    return F.pmod(F.xxhash64(F.coalesce(name, F.lit("")), name.isNull()), F.lit(1 << BITS)).cast("int")


def interleaved(x: Column, y: Column) -> Column:
    """The bits of two numbers of 16 bits, taken in turn."""
    key = F.lit(0).cast("long")
    for i in range(BITS):
        for j, value in enumerate((x, y)):
            bit = F.shiftright(value, i).bitwiseAND(F.lit(1)).cast("long")
            key = key.bitwiseOR(F.shiftleft(bit, 2 * i + j))
    return key


def write_clustered(silver: DataFrame, store: LayerStore, name: str = "silver_clustered", files: int = 64,
                    date_col: str = "effective_date", merchant_col: str = "counterparty", tag: str | None = None) -> int:
    """Commit ``silver`` with ``merchant_key`` as the next version of ``name``, in Z-order of date and merchant, in about ``files`` files."""
    low, high = silver.agg(F.min(date_col), F.max(date_col)).first()
    days = max(1, (high - low).days) if low is not None else 1
    place = F.coalesce(F.datediff(F.col(date_col), F.lit(low)) * ((1 << BITS) - 1) / F.lit(days), F.lit(0)).cast("int")
    keyed = silver.withColumn(MERCHANT_KEY, merchant_key(F.col(merchant_col))).withColumn("_z", interleaved(place, F.col(MERCHANT_KEY)))
    dealt = keyed.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
    return store.write(dealt, name, tag=tag)


def of_merchant(clustered: DataFrame, merchant: str | None, merchant_col: str = "counterparty") -> DataFrame:
    """Rows of one merchant: the key reaches the scan and skips row groups, the name decides."""
    return clustered.filter((F.col(MERCHANT_KEY) == merchant_key(F.lit(merchant).cast("string")))
                            & F.col(merchant_col).eqNullSafe(F.lit(merchant).cast("string")))
