"""The shared folder comes from the session (spark.checkpoint.dir), never a guess."""

from __future__ import annotations

import pytest

from alertledger.session import SQL_CONF, configure, scratch_dir, shared_dir


def test_shared_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = shared_dir(spark)
    assert configured is not None and base == configured.rstrip("/")
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(base + "/alertledger/") and b.startswith(base + "/alertledger/")


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_configure_sets_library_settings(spark):
    configure(spark)
    for key, value in SQL_CONF.items():
        assert spark.conf.get(key) == value
