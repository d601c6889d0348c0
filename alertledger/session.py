"""Session settings and the shared working folder.

The library never hard-codes a machine-local path for durable output: every
layer, stream checkpoint and export lands under the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (a laptop or a test)
do we create a private folder and register it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the library relies on. They are all settable on a live
# session, so ``configure`` may be applied to a session someone else built.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # The JVM never compiles a method above 8,000 bytes: the parse in one such method runs interpreted. Beyond
    # this limit Spark makes a projection of many small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "alertledger") -> SparkSession:
    """Session for tests, benches and local runs (no UI, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors for layers and checkpoints.

    Read from the session (``spark.checkpoint.dir`` or the SparkContext's
    checkpoint dir); a private one is made only in local mode when neither is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="alertledger-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unique sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/alertledger/{label}-{uuid.uuid4().hex[:12]}"
