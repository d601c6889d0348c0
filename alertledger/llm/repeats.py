"""Removal of byte strings of ``LENGTH`` or more that occur more than once in a corpus.

A position is removed if a 400-byte string that covers it also starts at another
position of any text. Instead of sorting every suffix of the corpus, names (ranks
by hash) are compared at growing lengths around a sample of positions, and
whatever turns out unique leaves:

1. every 400-byte string is represented by its anchor, the smallest hash among its
   128-byte strings (the first of equal ones). Equal strings have equal anchors at
   equal offsets, so only positions with equal anchors can start equal strings.
   One anchor stands for about 137 neighbouring positions (a run);
2. rank by the 128 bytes at the anchor: anchors that are alone leave;
3. rank by all bytes of the run's strings: where two runs agree, all their positions
   repeat. Of every distinct run one stays for the next rounds, with its count;
4. rank blocks of 32 start positions by the 369 bytes that all their strings share
   (alone: none repeats), and by all 431 bytes (equal: all repeat);
5. rank the single 400-byte strings of the blocks that are still open.

A group of equal names is only counted and joined back, never gathered, so a
passage in a third of all documents is not one task's work.

Names are 64-bit polynomial hashes, compared only among equal names of the round
before. Defined results: NULL text is empty; rows with equal id and text repeat
each other; NULL ids stay; texts under 400 bytes keep everything; extra columns
are not read; a table without rows gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored
from .hashing import Hashes, mix

LENGTH, GRAM, BLOCK = 400, 128, 32
SPAN = LENGTH - GRAM + 1  # 128-byte strings in a 400-byte string
SLICE = 1 << 20  # bytes that are hashed together
_U = np.uint64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima from both sides of blocks of ``width``."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    padded = padded.reshape(rows, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def _runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of start positions with one anchor in texts laid end to end; positions are in ``data``."""
    h = Hashes(data)
    grams = h(np.arange(len(data) - GRAM + 1), GRAM)
    order = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    smallest = _sliding_min(order, SPAN)
    n_starts = sizes - LENGTH + 1
    p = np.arange(n_starts.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n_starts)[:-1]]), n_starts)
    anchor = (smallest[p] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    a, p1, p2 = anchor[first], p[first], p[last]
    whole = h(p1, p2 + LENGTH - p1) ^ mix((a - p1).astype(np.uint64))
    return {"anchor": a, "p1": p1, "p2": p2, "gram": grams[a].view(np.int64), "whole": whole.view(np.int64)}


def text_runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of all texts: row (number of the text), anchor, p1, p2, gram, whole."""
    parts: list[dict[str, np.ndarray]] = []

    def flush(group: list[int]) -> None:
        if group:
            data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
            sizes = np.array([len(texts[i]) for i in group])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            r = _runs(data, starts, sizes)
            which = np.searchsorted(starts, r["p1"], "right") - 1
            for k in ("anchor", "p1", "p2"):
                r[k] = r[k] - starts[which]
            parts.append(r | {"row": np.array(group)[which]})

    group, total = [], 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > SLICE:  # in slices; the last run of a slice is found again, whole, by the next
            data, at, end = np.frombuffer(text, np.uint8), 0, len(text) - LENGTH + 1
            while at < end:
                part = data[at:at + SLICE + LENGTH - 1]
                r = _runs(part, np.zeros(1, np.int64), np.array([len(part)]))
                cut = at + len(part) - LENGTH + 1 < end
                keep = len(r["p1"]) - cut
                nxt = at + int(r["p1"][-1]) if cut else end
                r = {k: v[:keep] + at if k in ("anchor", "p1", "p2") else v[:keep] for k, v in r.items()}
                parts.append(r | {"row": np.full(keep, i)})
                at = nxt
            continue
        if total + len(text) > SLICE:
            flush(group)
            group, total = [], 0
        group.append(i)
        total += len(text)
    flush(group)
    names = ("row", "anchor", "p1", "p2", "gram", "whole")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def _run_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    r = text_runs(batch[1].cast(pa.binary()).to_pylist())
    return pa.RecordBatch.from_arrays(
        [batch[0].take(pa.array(r["row"])), *(pa.array(r[k].astype(np.int64)) for k in ("anchor", "p1", "p2", "gram", "whole"))],
        names=["doc", "anchor", "p1", "p2", "gram", "whole"])


def _contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Bytes around each open run, enough for all its blocks."""
    rows, out = [], {k: [] for k in ("gram", "weight", "doc", "anchor", "o1", "o2", "left", "bytes")}
    for doc, text, runs in zip(batch["doc"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(),
                               batch["runs"].to_pylist(), strict=True):
        for r in runs:
            o1, o2 = r["anchor"] - r["p2"], r["anchor"] - r["p1"]
            low = max(0, r["anchor"] - (o2 // BLOCK * BLOCK + BLOCK - 1))
            high = r["anchor"] - o1 // BLOCK * BLOCK + LENGTH
            for k, v in zip(out, (r["gram"], r["weight"], doc, r["anchor"], o1, o2, r["anchor"] - low, text[low:high]),
                            strict=True):
                out[k].append(v)
            rows.append(0)
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def _laid_out(batch: pa.RecordBatch) -> tuple[Hashes, dict[str, np.ndarray]]:
    texts = batch["bytes"].to_pylist()
    sizes = np.array([len(x) for x in texts])
    r = {k: batch[k].to_numpy() for k in ("gram", "weight", "doc", "anchor", "o1", "o2", "left")}
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return Hashes(np.frombuffer(b"".join(texts), np.uint8)), r | {"at": start + r["left"], "start": start, "size": sizes}


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Names of every block of start positions: the bytes all its strings share, and all its bytes (NULL at a text's end)."""
    if not batch.num_rows:
        return None
    h, r = _laid_out(batch)
    n = r["o2"] // BLOCK - r["o1"] // BLOCK + 1
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (r["o1"] // BLOCK)[row]
    near, far = r["at"][row] - BLOCK * j, r["at"][row] - BLOCK * j - (BLOCK - 1)  # starts of the last and first string
    core = h(near, LENGTH - BLOCK + 1)
    inside = (far >= r["start"][row]) & (near + LENGTH <= (r["start"] + r["size"])[row])
    full = np.zeros(len(row), np.uint64)
    full[inside] = h(far[inside], LENGTH + BLOCK - 1)
    columns = [pa.array(r[k][row]) for k in ("gram", "weight", "doc", "anchor")]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(j), pa.array(core.view(np.int64)), pa.array(full.view(np.int64), mask=~inside)],
        names=["gram", "weight", "doc", "anchor", "j", "core", "full"])


def _strings(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Names of the single strings of the open blocks."""
    if not batch.num_rows:
        return None
    h, r = _laid_out(batch)
    blocks = batch["blocks"].to_pylist()
    row = np.repeat(np.arange(len(blocks)), [len(b) * BLOCK for b in blocks])
    o = (np.array([j for b in blocks for j in b], np.int64)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
    keep = (o >= r["o1"][row]) & (o <= r["o2"][row])
    row, o = row[keep], o[keep]
    name = h(r["at"][row] - o, LENGTH)
    return pa.RecordBatch.from_arrays([*(pa.array(r[k][row]) for k in ("gram", "weight", "doc", "anchor")), pa.array(o),
                                       pa.array(name.view(np.int64))], names=["gram", "weight", "doc", "anchor", "o", "name"])


def _back(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """Join ``counted`` back to the rows. It is stored first: a join of two plain scans is one whose hot keys Spark splits."""
    return rows.join(counted, on)


def repeated_starts(texts: DataFrame) -> DataFrame:
    """doc, p1, p2: start positions (inclusive) of strings that occur elsewhere. ``texts``: doc long, text."""
    runs = stored(map_batches(texts, _run_rows, "doc long, anchor long, p1 long, p2 long, gram long, whole long"), "runs")
    shared = stored(runs.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared-grams")
    runs = stored(_back(runs, shared, ["gram"]), "shared-runs")

    wholes = runs.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min_by(
        F.struct("doc", "anchor", "p1", "p2"), F.struct("doc", "anchor")).alias("one"))
    wholes = stored(wholes, "whole-runs")
    same = _back(runs, wholes.filter("n > 1").select("gram", "whole"), ["gram", "whole"]).select("doc", "p1", "p2")

    # groups in which different runs meet; one of each distinct run goes on
    mixed = stored(wholes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram"), "mixed-grams")
    open_runs = (_back(wholes, mixed, ["gram"])
                 .select(F.col("one.doc").alias("doc"),
                         F.struct("gram", F.least("n", F.lit(2)).alias("weight"), "one.anchor", "one.p1", "one.p2").alias("run"))
                 .groupBy("doc").agg(F.collect_list("run").alias("runs")))
    once = texts.join(open_runs, "doc").dropDuplicates(["doc"])
    kinds = "gram long, weight long, doc long, anchor long"
    around = stored(map_batches(once, _contexts, f"{kinds}, o1 long, o2 long, left long, bytes binary", 200), "contexts")

    blocks = stored(map_batches(around, _blocks, f"{kinds}, j long, core long, full long"), "blocks")
    cores = (blocks.groupBy("gram", "j", "core")
             .agg(F.sum("weight").alias("n"), F.min("full").alias("low"), F.max("full").alias("high"),
                  F.count_if(F.col("full").isNull()).alias("cut"))
             .filter("n > 1").select("gram", "j", "core", F.expr("cut = 0 AND low = high").alias("equal")))
    cores = stored(cores, "shared-cores")
    blocks = stored(_back(blocks, cores, ["gram", "j", "core"]), "shared-blocks")
    equal = blocks.filter("equal").select("doc", (F.col("anchor") - F.col("j") * BLOCK - (BLOCK - 1)).alias("p1"),
                                          (F.col("anchor") - F.col("j") * BLOCK).alias("p2"))

    listed = blocks.filter("NOT equal").groupBy("doc", "anchor").agg(F.sort_array(F.collect_list("j")).alias("blocks"))
    names = stored(map_batches(around.join(listed, ["doc", "anchor"]), _strings, f"{kinds}, o long, name long"), "strings")
    again = names.groupBy("gram", "o", "name").agg(F.sum("weight").alias("n")).filter("n > 1").select("gram", "o", "name")
    again = stored(again, "shared-strings")
    single = _back(names, again, ["gram", "o", "name"]).select("doc", (F.col("anchor") - F.col("o")).alias("p1"))
    return same.unionByName(equal).unionByName(single.withColumn("p2", F.col("p1")))


def _merge(found: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    """Byte spans (start, end) that the start ranges cover, touching ones joined."""
    spans: list[tuple[int, int]] = []
    for p1, p2 in sorted((x["p1"], x["p2"]) for x in found or []):
        if spans and p1 <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], p2 + LENGTH))
        else:
            spans.append((p1, p2 + LENGTH))
    return spans


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, spans (start, end of removed bytes), kept_sha256, (kept: the bytes left)."""
    doc = F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc")
    texts = df.select(doc, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeated_starts(texts).groupBy("doc").agg(F.collect_set(F.struct("p1", "p2")).alias("found"))
    rows = df.select(F.col(id_col), doc, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(found, "doc", "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        spans = [_merge(x) for x in batch["found"].to_pylist()]
        kept = []
        for text, cuts in zip(texts, spans, strict=True):
            ends = [0, *(e for _, e in cuts)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in cuts), len(text)], strict=True)))
        arrays = [batch[id_col], pa.array([len(t) for t in texts], pa.int64()),
                  pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span),
                  pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = [id_col, "n_bytes", "spans", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, " \
             "spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_text
    return map_batches(rows.select(id_col, "text", "found"), remove, schema)
