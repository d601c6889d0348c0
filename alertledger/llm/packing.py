"""Pack tokenised documents into sequences of fixed size by exact-complement hashing, then best fit.

The lengths of all pieces are counted by Spark. The plan is made on those counts
alone (at most ``size`` numbers, whatever the corpus): for the longest length
left, a gap is filled exactly by one length, by two that sum to it, or by three;
the combination is used as often as its counts allow. A gap that nothing fills
exactly takes the longest length that fits. The plan is a list of (lengths,
times). Pieces of one length are numbered across the cluster and the number
tells the sequence and the offset, so no task sees all pieces.

Defined results: NULL text is empty and packs as the end token alone; NULL ids
stay; repeated rows are packed each; an empty table packs to no rows; extra
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, stored

SIZE, END = 1024, 2
NUMBER_GROUP = 4_000  # pieces that one task numbers together
_CACHE_LIMIT = 200_000  # a worker keeps it for as long as it lives, whatever it does next
_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


class ChunkEncoder:
    """Token ids of texts as packed bytes, each distinct space-separated chunk encoded once per process.

    Byte-level BPE never merges across the start of " x" (a space before a non-space) or across a line end
    between two non-spaces, so a text cut there encodes part by part. Texts with other white space are
    encoded whole. The vocabulary is read from ``path``: ``*.tiktoken`` holds the ranks of the same name's
    ``.json``; the ids are the same and are found several times faster. With ``added``, the added tokens of the
    ``.json`` are one id each where a text holds them, as in ``tokenizers``; such texts are encoded whole.
    """

    def __init__(self, path: str, added: bool = False):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._added: dict[str, int] = {}
        if added:
            with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
                self._added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens=self._added)
        self._encode, self._encode_added = encoding.encode_ordinary, encoding.encode
        self._cache: dict[str, bytes | None] = {}

    def _packed(self, text: str) -> bytes:
        ids = self._encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes | None:
        inner = chunk[1:] if chunk[:1] == "\n" else chunk
        if not inner or inner[0].isspace() or inner[-1].isspace():
            return None
        return self._packed(chunk if inner is not chunk else " " + chunk)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self._added):
            ids = self._encode_added(text, allowed_special="all")
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *chunks = text.replace("\n", " \n").split(" ")
        cache = self._cache
        found = list(map(cache.get, chunks))
        if None in found:
            if len(cache) > _CACHE_LIMIT:
                cache.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[i]
                    ids = cache[chunk] = cache.get(chunk) or self._chunk(chunk)
                    if ids is None:
                        return self._packed(text)
                    found[i] = ids
        if chunks and (not first or first[-1].isspace()):
            return self._packed(text)
        return self._packed(first) + b"".join(found)


def encoder(path: str, added: bool = False) -> ChunkEncoder:
    if (path, added) not in _encoders:
        _encoders[path, added] = ChunkEncoder(path, added)
    return _encoders[path, added]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_pieces(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
               size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and ``end``: only documents above ``size`` are cut, the first piece short."""
    tail = struct.pack("<I", end)
    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.binary())] * with_ids

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary or default_vocabulary(), added=True)
        rows, out = [], [[] for _ in kinds]
        for row, text in enumerate(batch[1].to_pylist()):
            ids = encode(text or "") + tail
            n = len(ids) // 4
            cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = ids[4 * a:4 * b]
                rows.append(row)
                for column, value in zip(out, (piece, a, b - a, zlib.crc32(part), part), strict=False):
                    column.append(value)
        arrays = [pa.array(x, kind) for x, (_, kind) in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows, pa.int32())), *arrays],
                                          names=[id_col, *(name for name, _ in kinds)])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, " \
             "ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(df.select(id_col, text_col), cut, schema)


def plan_sequences(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) patterns that use up ``counts``; the work depends on ``size``, not on the counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n

    def pair(gap: int, avail: np.ndarray) -> tuple[int, int] | None:
        big = np.arange((gap + 1) // 2, gap)
        ok = (avail[big] > 0) & (avail[gap - big] > np.where(2 * big == gap, 1, 0))
        at = np.flatnonzero(ok)
        return (int(big[at[-1]]), gap - int(big[at[-1]])) if len(at) else None

    def exact(gap: int, avail: np.ndarray) -> tuple[int, ...] | None:
        if gap == 0:
            return ()
        if avail[gap] > 0:
            return (gap,)
        if two := pair(gap, avail):
            return two
        for big in np.flatnonzero(avail[:gap])[::-1]:
            if 3 * big < gap:
                break
            avail[big] -= 1
            two = pair(gap - int(big), avail)
            avail[big] += 1
            if two:
                return (int(big), *two)
        return None

    plan = []
    for longest in range(size, 0, -1):
        while left[longest]:
            lengths, gap, avail = [longest], size - longest, left.copy()
            avail[longest] -= 1
            while (fill := exact(gap, avail)) is None:
                fits = np.flatnonzero(avail[:gap + 1])
                if not len(fits):
                    break
                lengths.append(int(fits[-1]))
                avail[fits[-1]] -= 1
                gap -= int(fits[-1])
            lengths += fill or ()
            need = Counter(lengths)
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            plan.append((tuple(lengths), times))
    return plan


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (stored: read more than once) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(counts, size)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: first number, first sequence, offset
    used: Counter[int] = Counter()
    sequences = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((used[length], sequences, offset))
            used[length] += times
            offset += length
        sequences += times
    table = {length: np.array(x, np.int64).T for length, x in slots.items()}

    own = pieces.columns
    groups = max(1, -(-sum(counts.values()) // NUMBER_GROUP))
    group = F.pmod(F.xxhash64(*(c for c in own if c != "ids")), F.lit(groups))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.groupBy("length", group.alias("_group")).agg(F.count("*").alias("n"))
              .select("length", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("length", "_group").orderBy(*(c for c in own if c not in ("length", "ids")))
    numbered = (pieces.withColumn("_group", group).withColumn("_number", F.row_number().over(within) - 1)
                .join(starts, ["length", "_group"])
                .select(*own, (F.col("_before") + F.col("_number")).alias("_number")))

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        number = batch.column("_number").to_numpy()
        sequence, offset = np.zeros_like(number), np.zeros_like(number)
        for x in np.unique(length):
            first, base, at = table[int(x)]
            rows = np.flatnonzero(length == x)
            slot = np.searchsorted(first, number[rows], "right") - 1
            sequence[rows] = base[slot] + number[rows] - first[slot]
            offset[rows] = at[slot]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(sequence), pa.array(offset)],
                                          names=[*own, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(numbered, put, f"{schema}, sequence_id long, offset long", rows=10_000)


def pack(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(stored(cut_pieces(df, vocabulary, id_col, text_col, size, end, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids (packed uint32)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
            .select("sequence_id", "n_tokens",
                    F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids")))
