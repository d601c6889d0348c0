"""A mailbox export as a Spark data source, batch and stream.

``spark.read.format("mailbox")`` and ``spark.readStream.format("mailbox")`` read the messages of an export: a folder
of JSON-lines files, one message a line, to which files are added whose names sort after those already there. The
stream's offset is the last file taken, so a restarted query goes on with the files after the one in its
checkpoint, also when old files have been removed. A file is one partition, read where Spark puts it; rows travel
as Arrow batches.

A field that a line does not have is NULL, a field that the schema does not have is left out; a line that is not a
JSON object is a message with only ``raw`` set, so nothing is lost. Files are read with pyarrow's file systems, so
the folder is a path or URI that every executor reaches.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FIELDS = ("id", "thread_id", "turn", "subject", "sender", "recipient", "body", "raw")
SCHEMA = ", ".join(f"{name} {'long' if name == 'turn' else 'string'}" for name in FIELDS)
_ARROW = pa.schema([(name, pa.int64() if name == "turn" else pa.string()) for name in FIELDS])
BATCH_LINES = 1000


class MailFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[str]:
    """Data files in the order of their names; hidden ones and those still being written (``_``, ``.``) are not there."""
    system, folder = _folder(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    names = [f.path for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if not any(part[:1] in "_." for part in n[len(folder):].strip("/").split("/")))


def _value(name: str, value) -> object:
    if name == "turn":
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    return value if value is None or isinstance(value, str) else json.dumps(value)


def read_file(base: str, path: str) -> Iterator[pa.RecordBatch]:
    system, _ = _folder(base)
    lines: list[dict] = []
    with io.BufferedReader(system.open_input_stream(path)) as stream:
        for line in stream:
            text = line.decode("utf-8", "replace").rstrip("\n")
            if not text.strip():
                continue
            try:
                record = json.loads(text)
            except ValueError:
                record = None
            if isinstance(record, dict):
                lines.append({name: _value(name, record.get(name)) for name in FIELDS[:-1]} | {"raw": None})
            else:
                lines.append(dict.fromkeys(FIELDS) | {"raw": text})
            if len(lines) == BATCH_LINES:
                yield pa.RecordBatch.from_pylist(lines, _ARROW)
                lines = []
    if lines:
        yield pa.RecordBatch.from_pylist(lines, _ARROW)


class MailboxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [MailFile(f) for f in list_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # an empty folder
            yield from read_file(self.path, partition.path)


class MailboxStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        return {"last": files[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [MailFile(f) for f in list_files(self.path) if start["last"] < f <= end["last"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_file(self.path, partition.path)

    def commit(self, end: dict) -> None:
        pass


class MailboxSource(DataSource):
    """Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MailboxReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return MailboxStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session. On a cluster this package is installed where executors run Python."""
    spark.dataSource.register(MailboxSource)


def export_messages(messages: DataFrame, path: str, number: int) -> None:
    """Add export ``number`` (growing) to a mailbox folder as JSON lines."""
    messages.write.mode("errorifexists").json(f"{path}/export={number:06d}")
