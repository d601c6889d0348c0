"""Exact duplicates of whole texts by composable polynomial fingerprints.

A text's fingerprint is its length in bytes and, for each of two primes, the value of its bytes as the digits
of a number in a fixed base. Fingerprints compose: that of two parts put together is the first one times the
base to the length of the second, plus the second (``combine``). So a text of more than ``CHUNK`` bytes is cut,
its chunks are dealt over the cluster and hashed there, each shifted by the bytes that follow it, and the sum
modulo the prime is the fingerprint of the whole; no task hashes a long text alone.

Equal fingerprints are not trusted. The texts of every fingerprint that occurs more than once are compared
chunk by chunk: per (fingerprint, chunk number) the smallest and the largest chunk must be the same bytes. Both
are combined in each task before anything is shuffled, so a text in a third of all rows is one row a task. In
a fingerprint whose chunks differ, the rows are told apart by their whole texts.

A group's verdict reaches its rows without gathering them: groups that hold a ten-thousandth of all rows or
more (at most 10,000 of them) are sent to every task, the rest is joined by a shuffle.

Defined results: texts are equal when identical after lower-casing A-Z only; a NULL text is the empty text;
the row with the largest id stays, NULL ids count as smallest; of repeated rows with that id one stays; an
empty table gives no rows; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, semi_join, ship, spread_join, stored

CHUNK = 1 << 16
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_320_577_513, 887_216_369)
Print = tuple[int, ...]  # length in bytes, then the value for each prime


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** (n - 1), ..., base, 1 modulo prime."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:  # the powers so far, then the same times the next one
        out = np.concatenate([out * np.uint64(step) % np.uint64(prime), out])
        step = step * step % prime
    return out[len(out) - n:]


class Fingerprints:
    """Fingerprints for some primes (below 2**31) and bases."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = [_powers(b, p, chunk) for b, p in zip(bases, primes, strict=True)]

    def of_chunk(self, data) -> Print:
        """Of at most ``chunk`` bytes: below 2**39 each, so the sum of 2**16 of them needs no reduction."""
        digits = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(digits)
        return n, *(int(np.dot(digits, w[len(w) - n:])) % p for w, p in zip(self.powers, self.primes, strict=True))

    def shift(self, value: Print, after: int) -> Print:
        """``value`` as a part of a text that goes on for ``after`` bytes."""
        return value[0], *(v * pow(b, after, p) % p for v, b, p in zip(value[1:], self.bases, self.primes, strict=True))

    def combine(self, left: Print, right: Print) -> Print:
        moved = self.shift(left, right[0])
        return left[0] + right[0], *((x + y) % p for x, y, p in zip(moved[1:], right[1:], self.primes, strict=True))


def _normal(text) -> bytes:
    return (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()  # bytes: A-Z only


def _short_prints(docs: DataFrame, prints: Fingerprints, keep_text: bool) -> DataFrame:
    """Fingerprints of texts of at most one chunk, with the text (as its only chunk) or its SHA-256."""
    names = [f"h{i}" for i in range(len(prints.primes))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_normal(x) for x in batch["text"]]
        values = list(zip(*map(prints.of_chunk, texts), strict=True))
        columns = {"row": batch["row"], "id": batch["id"], "n_bytes": pa.array(values[0], pa.int64()),
                   **{n: pa.array(v, pa.int64()) for n, v in zip(names, values[1:], strict=True)}}
        if keep_text:
            columns["chunk"] = pa.array(texts, pa.binary())
        else:
            columns["sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_bytes long, {', '.join(f'{n} long' for n in names)}, " + ("chunk binary" if keep_text else "sha256 string")
    return map_batches(docs, run, schema)


def _long_chunks(docs: DataFrame, prints: Fingerprints) -> DataFrame:
    """Chunks of the longer texts with their shifted fingerprints, hashed wherever they were dealt to."""
    names = [f"h{i}" for i in range(len(prints.primes))]
    kind, size = docs.schema["id"].dataType.simpleString(), prints.chunk

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["id"], batch["text"], strict=True):
                data = _normal(text)
                digest = hashlib.sha256(data).hexdigest()
                for no, at in enumerate(range(0, len(data), size)):
                    chunk = data[at:at + size]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row.as_py()], pa.int64()), "id": pa.array([doc.as_py()], batch["id"].type),
                        "no": pa.array([no], pa.int32()), "after": pa.array([len(data) - at - len(chunk)], pa.int64()),
                        "chunk": pa.array([chunk], pa.binary()), "sha256": pa.array([digest], pa.string())})

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [prints.shift(prints.of_chunk(c.as_buffer()), n.as_py()) for c, n in zip(batch["chunk"], batch["after"], strict=True)]
        lengths, *rest = zip(*values, strict=True)
        columns = {c: batch[c] for c in ("row", "id", "no", "chunk", "sha256")}
        return pa.RecordBatch.from_pydict(columns | {"n": pa.array(lengths, pa.int64())} | {
            n: pa.array(v, pa.int64()) for n, v in zip(names, rest, strict=True)})

    ship(docs.sparkSession)
    cuts = docs.mapInArrow(cut, f"row long, id {kind}, no int, after long, chunk binary, sha256 string")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(cuts.repartition(tasks, "row", "no"), hashed,
                       f"row long, id {kind}, no int, chunk binary, sha256 string, n long, {', '.join(f'{n} long' for n in names)}")


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prints: Fingerprints | None = None) -> DataFrame:
    """Per row of ``df``: id, keep_id (of the row of its text that stays), group_size, kept, text_sha256, n_bytes, fingerprint."""
    prints = prints or Fingerprints()
    names = [f"h{i}" for i in range(len(prints.primes))]
    key = ["n_bytes", *names]
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.octet_length("text") > prints.chunk, F.lit(False))

    chunks = stored(_long_chunks(docs.filter(long), prints), "copies-chunks")
    whole = chunks.groupBy("row").agg(
        F.first("id").alias("id"), F.sum("n").alias("n_bytes"),
        *((F.sum(n) % p).alias(n) for n, p in zip(names, prints.primes, strict=True)), F.first("sha256").alias("sha256"))
    rows = stored(_short_prints(docs.filter(~long), prints, keep_text=False).unionByName(whole), "copies-prints")

    several = stored(rows.groupBy(*key).count().filter("count > 1").select(*key), "copies-several")
    suspects = _chunks_of(docs, long, chunks, rows, several, key, prints)
    differing = stored(suspects.groupBy(*key, "no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
                       .filter("least <> most").select(*key).distinct(), "copies-differing")
    classed = rows.withColumn("variant", F.lit(0))
    if not differing.isEmpty():
        classed = _told_apart(docs, rows, differing, key, prints)

    key = [*key, "variant"]
    best = F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("best")
    groups = stored(classed.groupBy(*key).agg(F.count("*").alias("group_size"), best), "copies-groups")
    out = spread_join(classed, groups, key, "group_size")
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
                      (F.col("best.row") == -F.col("row")).alias("kept"), F.col("sha256").alias("text_sha256"),
                      "n_bytes", F.array(*names).alias("fingerprint"))


def _chunks_of(docs: DataFrame, long, chunks: DataFrame, rows: DataFrame, several: DataFrame, key: list[str],
               prints: Fingerprints) -> DataFrame:
    """(fingerprint, no, chunk) of the rows whose fingerprint occurs more than once."""
    short = _short_prints(docs.filter(~long), prints, keep_text=True).select(*key, F.lit(0).alias("no"), "chunk")
    parts = chunks.select("row", "no", "chunk").join(rows.filter(F.col("n_bytes") > prints.chunk).select("row", *key), "row")
    return semi_join(short.unionByName(parts.select(*key, "no", "chunk")), several, key)


def _told_apart(docs: DataFrame, rows: DataFrame, differing: DataFrame, key: list[str], prints: Fingerprints) -> DataFrame:
    """``rows`` with the number of their text among the different texts of their fingerprint."""
    unsure = semi_join(rows, differing, key)
    texts = docs.select("row", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("whole"))
    read = stored(unsure.join(texts, "row"), "copies-unsure")
    texts_of = Window.partitionBy(*key).orderBy("whole")
    numbered = stored(read.groupBy(*key, "whole").agg(F.count("*").alias("size"))
                      .withColumn("variant", F.row_number().over(texts_of)), "copies-variants")
    told = spread_join(read, numbered, [*key, "whole"], "size").select(*rows.columns, "variant")
    certain = rows.join(F.broadcast(differing) if differing.count() <= 100_000 else differing, key, "left_anti")
    return stored(certain.withColumn("variant", F.lit(0)).unionByName(told), "copies-told-apart")
