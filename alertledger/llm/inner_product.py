"""Exact top-k inner products by norm buckets.

Vectors are sorted by length into buckets of ``bucket_rows``; queries come in blocks.
The bucket of the longest vectors is searched first and gives each query a score to
beat. For every other bucket that score, divided by the query's length and the
bucket's largest length, is the cosine a candidate must reach there:

* above 1 the bucket is skipped whole;
* if it is small, only the vectors long enough for the score are taken (length pruning);
* if it is large, each of the query's largest coordinates bounds the candidates' same
  coordinates to an interval, and only vectors inside all intervals are taken
  (coordinate pruning).

What is left is verified by its product. The buckets are independent, so there is one
task for each pair of a bucket and a query block.

Defined results: rows without id, and vectors that are NULL or hold a NULL or non-finite component, take no
part; vectors of different dimension are not compared; ties go to the smaller id; equal
vectors are all candidates; a query has fewer than ``k`` rows if there are fewer
candidates; extra columns are not read. Components must be below 2**40 in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_batches, ship, stored

BUCKET_ROWS, QUERY_ROWS = 4096, 1024
SMALL_COSINE = 0.35  # below it coordinate intervals are too wide to help
FOCUS = 4  # coordinates that bound the candidates


def usable(vector: Column) -> Column:
    """True for vectors without NULL or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _packed(df: DataFrame, group: str) -> DataFrame:
    """One row per ``group``: ids and vectors (float64) as bytes, longest first, dim."""
    ship(df.sparkSession)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ids = t["id"].to_numpy()
        length = np.sqrt((v * v).sum(axis=1))
        order = np.lexsort((ids, -length))
        return pa.table({group: [key[0].as_py()], "dim": pa.array([dim], pa.int32()), "ids": [ids[order].tobytes()],
                         "vectors": [v[order].tobytes()]})

    return df.groupBy(group).applyInArrow(pack, f"{group} long, dim int, ids binary, vectors binary")


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers held as float64."""
    if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[-1] < 2.0 ** 53:
        return (v @ q).astype(np.int64)
    return v.astype(np.int64) @ q.astype(np.int64)


def search_bucket(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, beat: np.ndarray, k: int):
    """(query, id, score) of at most ``k`` candidates of a bucket per query; v is sorted by length, longest first."""
    lengths = np.sqrt((v * v).sum(axis=1))
    unit = v / np.maximum(lengths, 1e-300)[:, None]
    out = []
    for qid, q, least in zip(query_ids, queries, beat, strict=True):
        own = float(np.sqrt(q @ q))
        reach = own * lengths[0]
        if least > reach * (1 + 1e-9) + 1e-6:
            continue  # not even a parallel vector of the bucket's largest length gets there
        cosine = least / reach if reach > 0 else -1.0
        if cosine <= SMALL_COSINE:
            n = len(v) if least <= 0 else int(np.searchsorted(-lengths, -(least / max(own, 1e-300)) * (1 - 1e-9) + 1e-6, "right"))
            rows = np.arange(n)
        else:
            direction = q / own
            focus = np.argsort(-np.abs(direction))[:FOCUS]
            spread = np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - direction[focus] ** 2))
            centre = direction[focus] * cosine
            inside = np.ones(len(v), bool)
            for f, c, s in zip(focus, centre, spread, strict=True):
                # cosine >= t bounds the coordinate only on the far side when the own coordinate exceeds t
                low = c - s if direction[f] > -cosine else -1.0
                high = c + s if direction[f] < cosine else 1.0
                inside &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
            rows = np.flatnonzero(inside)
        rows = rows[ids[rows] != qid]
        if len(rows):
            score = _products(v[rows], q)
            best = rows[_top(score, ids[rows], k)]
            value = _products(v[best], q)
            good = value >= least
            out += [(int(qid), int(ids[b]), int(s)) for b, s in zip(best[good], value[good], strict=True)]
    return out


def _search(df: DataFrame, k: int) -> DataFrame:
    """Rows of a bucket joined with a query block and ``beat``: candidates (query_id, id, score)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[int, int, int]] = []
        for r in batch.to_pylist():
            dim = r["dim"]
            queries = np.frombuffer(r["q_vectors"]).reshape(-1, dim)
            query_ids = np.frombuffer(r["q_ids"], np.int64)
            beat = np.full(len(query_ids), -np.inf)
            known = dict(zip((b["query_id"] for b in r["beat"] or ()), (b["score"] for b in r["beat"] or ()), strict=True))
            if known:
                beat = np.array([known.get(int(q), -np.inf) for q in query_ids])
            found += search_bucket(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, dim),
                                   query_ids, queries, beat, k)
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    return map_batches(df, run, "query_id long, id long, score long", rows=4)


def top_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding", bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` rows of largest integer product for the rows that ``queries`` marks: query_id, rank, id, score."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = (vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), queries.alias("is_query")))
    rows = rows.withColumn("dim", F.size("v")).withColumn(
        "length", F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x))
    rows = stored(rows, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    buckets = max(1, -(-n // bucket_rows))
    sorted_rows = rows.repartitionByRange(buckets, F.col("dim"), F.col("length").desc(), F.col("id"))
    numbered = stored(sorted_rows.select("id", "v", "dim", F.spark_partition_id().cast("long").alias("part")), "norm-buckets")
    # partitions follow (dim, length): a bucket is the part of one dimension in one partition
    bucket = F.col("part") * 4096 + F.col("dim") % 4096
    packed = stored(_packed(numbered.withColumn("bucket", bucket), "bucket"), "packed-buckets")
    blocks = max(1, -(-n_queries // query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)) * 4096 + F.col("dim") % 4096
    asked = _packed(rows.filter("is_query").withColumn("block", block), "block")
    asked = stored(asked.select("block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
                                F.col("vectors").alias("q_vectors")), "query-blocks")

    # the longest bucket of each dimension first; then every other, with the score to beat
    order = Window.partitionBy("dim").orderBy("bucket")
    ranked = stored(packed.select("bucket", "dim", (F.row_number().over(order) - 1).alias("nth")), "bucket-order")
    grid = ranked.join(asked.select("block", F.col("q_dim").alias("dim")), "dim").select("bucket", "block", "nth")
    first = grid.filter("nth = 0").join(packed, "bucket").join(asked, "block").withColumn(
        "beat", F.array().cast("array<struct<query_id:long,score:long>>"))
    seen = stored(_search(first, k), "first-candidates")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = seen.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == k).select("query_id", "score")
    kth = (kth.join(rows.select(F.col("id").alias("query_id"), block.alias("block")), "query_id")
           .groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("beat")))
    others = (grid.filter("nth > 0").repartition(max(1, buckets), "bucket", "block")
              .join(packed, "bucket").join(asked.join(kth, "block", "left"), "block"))
    found = seen.union(_search(others, k))
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
