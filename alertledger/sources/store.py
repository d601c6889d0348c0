"""Versioned parquet layers in the shared folder.

A layer is a folder of immutable versions ``v=000001``, ``v=000002`` … . A
version becomes visible only once Spark's output committer has written its
``_SUCCESS`` marker, so a job that dies half-way (lost executors are retried
by Spark; a lost driver leaves an uncommitted folder) never exposes partial
data. Because a new version is a new folder, a layer can be rewritten from a
plan that reads its own current version (the upsert), which a plain
``mode("overwrite")`` on the same path forbids. Reading a committed version is
also a lineage cut.

An append-only commit is a segment ``a=000003`` after the version it adds to; a
read is the newest version and all later segments. Versions and segments share one
numbering. Two writers that pick the same number: the second finds the folder and
fails.

An optional ``tag`` (for a stream: query id and batch id) makes commits idempotent: a
replayed ``foreachBatch`` finds its tag already committed and does nothing.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_VERSION = re.compile(r"^v=(\d+)(?:-t=(.+))?$")
_SEGMENT = re.compile(r"^a=(\d+)(?:-t=(.+))?$")
_BUCKET_FILE = re.compile(r"_\d{5}\.c\d+\.")
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class LayerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(conf)

    # -- listing ---------------------------------------------------------
    def _folders(self, name: str) -> list[str]:
        path = self._Path(f"{self.root}/{name}")
        return [f.getPath().toString() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _versions(self, name: str, pattern=_VERSION) -> list[tuple[int, str | None, str]]:
        found = []
        for path in self._folders(name):
            m = pattern.match(path.rpartition("/")[2])
            if m and self._fs.exists(self._Path(path, "_SUCCESS")):
                found.append((int(m.group(1)), m.group(2), path))
        return sorted(found)

    def current_version(self, name: str) -> int:
        versions = self._versions(name)
        return versions[-1][0] if versions else 0

    def _next(self, name: str) -> int:
        """A number above every folder of the layer, committed or left by a writer that died."""
        numbers = [int(m[1]) for m in (re.match(r"[va]=(\d+)", p.rpartition("/")[2]) for p in self._folders(name)) if m]
        return max(numbers, default=0) + 1

    def has_tag(self, name: str, tag: str) -> bool:
        return any(t == str(tag) for _, t, _ in self._versions(name) + self._versions(name, _SEGMENT))

    def version_of(self, name: str, tag: str) -> int:
        """Number of the version committed under ``tag``."""
        return next(number for number, t, _ in self._versions(name) if t == str(tag))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name) or self._versions(name, _SEGMENT))

    # -- read / write ------------------------------------------------------
    def read(self, name: str, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The newest version and the segments after it, or one version as it was written.

        With ``schema`` no footer is read, and a layer that was committed without rows can be read.
        """
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        versions = self._versions(name)
        if version is not None:
            return reader.parquet(next(path for number, _, path in versions if number == version))
        newest = versions[-1:]
        later = [x for x in self._versions(name, _SEGMENT) if not newest or x[0] > newest[0][0]]
        if not newest and not later:
            raise FileNotFoundError(f"layer {name!r} has no committed version under {self.root}")
        frames = [reader.parquet(x[2]) for x in newest]
        if later:
            frames.append(reader.parquet(*[x[2] for x in later]))
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def read_tag(self, name: str, tag: str, schema: StructType | None = None) -> DataFrame:
        """The one segment or version committed under ``tag``."""
        for _, t, path in self._versions(name, _SEGMENT) + self._versions(name):
            if t == str(tag):
                return (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(path)
        raise FileNotFoundError(f"layer {name!r} has no commit tagged {tag!r}")

    def write(self, df: DataFrame, name: str, tag: str | None = None,
              partition_by: list[str] | None = None, sort_within=None, options: dict[str, str] | None = None) -> int:
        """Full-refresh commit of ``df`` as the next version; returns its number. ``options``: of the parquet writer.

        ``sort_within`` orders rows inside each output file (no global sort,
        so no range shuffle); readers that need an order sort on read.
        """
        if tag is not None and self.has_tag(name, tag):
            return self.current_version(name)
        if sort_within:
            df = df.sortWithinPartitions(*sort_within)
        nxt = self._next(name)
        folder = f"v={nxt:06d}" + (f"-t={tag}" if tag is not None else "")
        writer = df.write.mode("errorifexists").options(**(options or {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/{folder}")
        return nxt

    def append(self, df: DataFrame, name: str, tag: str | None = None,
               partition_by: list[str] | None = None) -> int:
        """Append-only layer: each call commits one new segment; reads see all segments.

        Earlier rows are never rewritten, so appending stays proportional to the
        new data however long the layer grows.
        """
        if tag is not None and self.has_tag(name, tag):
            return next(n for n, t, _ in self._versions(name, _SEGMENT) + self._versions(name) if t == str(tag))
        nxt = self._next(name)
        folder = f"a={nxt:06d}" + (f"-t={tag}" if tag is not None else "")
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/{folder}")
        return nxt

    # -- bucketed layers ---------------------------------------------------
    def _table(self, name: str, version: int) -> str:
        digest = hashlib.sha1(self.root.encode()).hexdigest()[:10]
        return f"alertledger_{digest}_{name}_v{version}"

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int, tag: str | None = None,
                       sort_within: list[str] | None = None) -> int:
        """Commit ``df`` as the next version, stored as a Spark bucketed table on ``key``.

        The files live in the version folder like any other version; the
        session catalog records the bucket layout so later joins on ``key``
        read them already partitioned and skip the shuffle of this side.
        """
        if tag is not None and self.has_tag(name, tag):
            return self.current_version(name)
        nxt = self._next(name)
        folder = f"v={nxt:06d}" + (f"-t={tag}" if tag is not None else "")
        writer = df.write.mode("errorifexists").bucketBy(buckets, key)
        if sort_within:
            writer = writer.sortBy(*sort_within)
        writer.option("path", f"{self.root}/{name}/{folder}").saveAsTable(self._table(name, nxt))
        return nxt

    def is_bucketed(self, name: str) -> bool:
        """Whether the newest version was written by ``write_bucketed``: the bucket is in the names of its files."""
        path = self._Path(self._versions(name)[-1][2])
        names = [f.getPath().getName() for f in self._fs.listStatus(path)]
        data = [n for n in names if n.endswith(".parquet")]
        return bool(data) and all(_BUCKET_FILE.search(n) for n in data)

    def read_bucketed(self, name: str, key: str, buckets: int) -> DataFrame:
        """Current version of a bucketed layer (registered in this session's catalog if needed)."""
        versions = self._versions(name)
        if not versions:
            raise FileNotFoundError(f"layer {name!r} has no committed version under {self.root}")
        number, _, path = versions[-1]
        table = self._table(name, number)
        if not self.spark.catalog.tableExists(table):
            # A version written by another session: describe its files and bucket layout
            # to this session's catalog (the bucket id is in each file name).
            schema = self.spark.read.parquet(path).schema
            names = [f.name for f in schema.fields]
            if not all(_IDENT.match(n) for n in names + [key, table]) or "'" in path:
                raise ValueError("unsafe identifier or path for catalog registration")
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) "
                           f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def changes_between(self, name: str, before: int, after: int, key="id") -> DataFrame:
        """S7 on stored data: the row-change feed turning version ``before`` into ``after``."""
        from ..operators.changes import change_feed
        return change_feed(self.read(name, before), self.read(name, after), key, version=after)

    def counts(self, names: list[str]) -> DataFrame:
        """Row count per committed layer, one union of global counts."""
        from ..operators.ops import layer_counts
        return layer_counts({n: self.read(n) for n in names if self.exists(n)})
