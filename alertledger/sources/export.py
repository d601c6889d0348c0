"""Ledger export to CSV.

Array columns are joined into one display string first (F12) since CSV has no
list type. NULL is written as ``\\N`` so it survives a round trip distinct from
an empty string, times keep their microseconds, and line ends, quotes and outer
blanks in a cell are kept (quoted cells, read back as multi-line CSV). Spark
writes one file per task in parallel; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

NULL_TOKEN = "\\N"
_OPTIONS = {"header": "true", "nullValue": NULL_TOKEN, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
            "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _flatten_arrays(df: DataFrame, sep: str = ",") -> DataFrame:
    cols = [F.array_join(F.col(f.name), sep).alias(f.name) if isinstance(f.dataType, ArrayType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def export_csv(df: DataFrame, path: str) -> str:
    _flatten_arrays(df).write.mode("overwrite").options(**_OPTIONS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**_OPTIONS).schema(schema).csv(path)
