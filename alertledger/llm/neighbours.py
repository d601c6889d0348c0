"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Equal vectors are one node of the graph. The graph starts from random projections:
nodes are sorted along them (a tree of hyperplanes, deep enough for leaves of about a
block) and cut into small blocks, and each node takes its nearest block mates. NN-descent then improves it by joins: every node gathers its
neighbours and the nodes that have it as neighbour (``degree`` of each, the nearest),
all pairs that meet at a node are measured, and each node keeps the ``degree`` nearest
it has heard of. Rounds end when at most ``SETTLED`` of the neighbours change; a graph that
does not settle in ``MAX_ROUNDS`` is an error, not a result. These joins carry vectors rounded
to 8 bits a component; the search measures the originals.

A query that is a row of the table enters the graph at its own node (others would
enter anywhere): its pool starts with the neighbours there; each step expands the
nearest ``beam`` pool members that are not expanded yet, through neighbours in both
directions, until no step changes a pool. Every row is indexed; results carry exact
distances. Recall is measured against brute force in the tests.

Defined results: rows without id, and vectors that are NULL or zero or hold a NULL or
non-finite component, take no part; equal vectors are all candidates, the smaller ids first; a query has
fewer than ``k`` rows if there are fewer candidates; vectors of another dimension than
the query's are not compared; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_batches, ship, stored
from .inner_product import usable

DEGREE, TREES, BLOCK, MAX_ROUNDS, BEAM, STEPS = 32, 6, 1024, 60, 128, 12
SETTLED = 0.01  # rounds go on while more than this share of the neighbours changes
PART_ROWS = 12_288  # nodes that one task sorts and cuts into blocks


def _vectors(binary: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed vectors (doubles) as rows."""
    packed = binary.to_pylist()
    return np.frombuffer(b"".join(packed)).reshape(len(packed), -1)


def _rounded(v: np.ndarray) -> list[bytes]:
    """Each vector as 8-bit numbers and their scale, a quarter or less of its size."""
    scale = np.maximum(np.abs(v).max(axis=1), 1e-300) / 127
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return [x.tobytes() + c.tobytes() for x, c in zip(scale, codes, strict=True)]


def _unrounded(binary: pa.Array | pa.ChunkedArray) -> np.ndarray:
    packed = binary.to_pylist()
    data = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    scale = np.ascontiguousarray(data[:, :8]).view(np.float64)
    return (data[:, 8:].view(np.int8) * scale).astype(np.float32)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows with rows."""
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _block_neighbours(ids: np.ndarray, v: np.ndarray, degree: int):
    square = (v * v).sum(axis=1)
    d = square[:, None] + square[None, :] - 2 * (v @ v.T)
    np.fill_diagonal(d, np.inf)
    k = min(degree, len(ids) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    a = np.repeat(np.arange(len(ids)), k)
    b = near.ravel()
    return ids[a], ids[b], _distances(v[a], v[b])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a partition sorted by ``key``, about 4000 rows at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows >= 4000:
            keys = rest[key].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield rest.slice(0, cut)
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def tree_depth(n: int, block: int) -> int:
    """Hyperplanes that cut ``n`` nodes into leaves of about ``block``."""
    return max(0, math.ceil(math.log2(n / block))) if n else 0


def _start(nodes: DataFrame, dim: int, trees: int, degree: int, block: int) -> DataFrame:
    """Neighbours within blocks along the random projections of ``trees`` trees: a, b, d."""
    n = nodes.count()
    depth = tree_depth(n, block)
    planes = [np.random.default_rng(1000 + tree).normal(size=(dim, depth + 1)) for tree in range(trees)]

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, spots = _vectors(batch["v"]), []
        for tree in planes:
            side = v @ tree
            # order of a binary tree of hyperplanes, and along one more direction within its leaves
            code = ((side[:, :depth] > 0) @ (1 << np.arange(depth))[::-1]).astype(np.float64)
            spots.append(code + 1 / (1 + np.exp(-side[:, depth] / (np.abs(side[:, depth]).mean() + 1e-12))))
        rows = pa.array(np.tile(np.arange(batch.num_rows), trees))
        tree_of = pa.array(np.repeat(np.arange(trees, dtype=np.int32), batch.num_rows))
        return pa.RecordBatch.from_arrays([batch["node"].take(rows), batch["v"].take(rows), tree_of, pa.array(np.concatenate(spots))],
                                          names=["node", "v", "tree", "spot"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # PART_ROWS rows or so
        if not sum(b.num_rows for b in own):
            return
        t = pa.Table.from_batches(own).sort_by([("tree", "ascending"), ("spot", "ascending"), ("node", "ascending")])
        ids, v = t["node"].to_numpy(), _vectors(t["v"])
        edge = np.flatnonzero(np.diff(t["tree"].to_numpy())) + 1
        for lo, hi in zip([0, *edge], [*edge, len(ids)], strict=True):
            for at in range(lo, hi, block):
                stop = at + block if hi - at >= 2 * block or at + block >= hi else hi
                stop = min(stop, hi)
                a, b, d = _block_neighbours(ids[at:stop], v[at:stop], degree)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])
                if stop == hi:
                    break

    placed = map_batches(nodes, project, "node long, v binary, tree int, spot double")
    return (placed.repartitionByRange(max(1, -(-n * trees // PART_ROWS)), "tree", "spot", "node")
            .mapInArrow(cut, "a long, b long, d double"))


def _closest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest neighbours of each node; ``edges`` holds a pair once."""
    order = Window.partitionBy("a").orderBy("d", "b")
    return edges.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= degree).drop("n")


def _lists(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """One row a node (stored): a, near (d, b of its ``degree`` nearest distinct neighbours), changed (how many of them are not
    ``old``) and its code. All is done where the node's ``edges`` (a, b, d, old) have been sent."""
    pairs = edges.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.max("old").alias("old"))
    near = _closest(pairs, degree).groupBy("a").agg(
        F.sort_array(F.collect_list(F.struct("d", "b"))).alias("near"), F.count_if(~F.col("old")).alias("changed"))
    return stored(near.join(nodes.select(F.col("node").alias("a"), "code"), "a"), "graph")


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.explode("near").alias("x")).select("a", "x.b", "x.d")


def _descend(lists: DataFrame, degree: int) -> DataFrame:
    """Pairs (a, b, d) that meet at a node and are nearer than what one of them has.

    Each node sends what it is measured by to its neighbours: two shuffles, to the neighbours and to where pairs meet.
    """
    ship(lists.sparkSession)
    known = lists.select("a", "code", F.array_max("near.d").alias("far"), "near")
    own = known.select(F.col("a").alias("at"), F.col("a").alias("u"), F.lit(None).cast("double").alias("d"), "code", "far")
    sent = known.select(F.col("a").alias("u"), "code", "far", F.explode("near").alias("x")).select(F.col("x.b").alias("at"), "u", "x.d", "code", "far")
    order = Window.partitionBy("at").orderBy(F.col("d").asc_nulls_first(), "u")  # the node's own row first
    first = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heard = own.union(sent).repartition("at").select(
        "at", "u", "code", "far", (F.row_number().over(order) - 1).alias("n"),
        F.first("code").over(first).alias("own_code"), F.first("far").over(first).alias("own_far")).filter("n > 0")
    to_sender = F.struct(F.col("u").alias("a"), F.col("at").alias("u"), F.col("own_code").alias("code"), F.col("own_far").alias("far"))
    from_sender = F.struct(F.col("at").alias("a"), "u", "code", "far")
    both = F.when(F.col("n") <= degree, F.array(to_sender, from_sender)).otherwise(F.array(to_sender))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "a"):
            at, u = (t[c].to_numpy() for c in ("a", "u"))
            t = t.filter(pa.array(np.append(True, (at[1:] != at[:-1]) | (u[1:] != u[:-1]))))  # neighbours both ways come twice
            at, u, far = (t[c].to_numpy() for c in ("a", "u", "far"))
            v = _unrounded(t["code"])
            edge = np.flatnonzero(np.diff(at)) + 1
            out = []
            for lo, hi in zip([0, *edge], [*edge, len(at)], strict=True):
                x = v[lo:hi]
                square = (x * x).sum(axis=1)
                d = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * (x @ x.T)))
                i, j = np.nonzero(d < far[lo:hi, None])
                ok = i != j
                out.append((lo + i[ok], lo + j[ok]))
            i, j = (np.concatenate([o[k] for o in out]) for k in (0, 1))
            apart = _distances(v[i], v[j]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(u[i]), pa.array(u[j]), pa.array(apart)],
                                             names=["a", "b", "d"])

    gathered = heard.select(F.explode(both).alias("x")).select("x.*")
    return gathered.repartition("a").sortWithinPartitions("a", "u").mapInArrow(pairs, "a long, b long, d double")


def build_graph(nodes: DataFrame, degree: int = DEGREE, trees: int = TREES, max_rounds: int = MAX_ROUNDS,
                block: int = BLOCK) -> DataFrame:
    """a, b, d: the nearest neighbours of each node found. ``nodes``: node long, dim int, v (packed doubles), code (rounded)."""
    first = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("d")).limit(0)
    for dim in sorted(r["dim"] for r in nodes.select("dim").distinct().collect()):
        first = first.union(_start(nodes.filter(F.col("dim") == dim).select("node", "v"), dim, trees, degree, block))
    graph = _lists(first.withColumn("old", F.lit(False)), nodes, degree)
    for _ in range(max_rounds):
        met = _descend(graph, degree).withColumn("old", F.lit(False))
        graph = _lists(_edges(graph).withColumn("old", F.lit(True)).union(met), nodes, degree)
        # pairs that the graph before did not have, and all
        changed, held = (n or 0 for n in graph.agg(F.sum("changed"), F.sum(F.size("near"))).first())
        if changed <= SETTLED * held:
            return _edges(graph)
    raise RuntimeError(f"the neighbour graph did not settle in {max_rounds} rounds: {changed} neighbours changed in the last")


def _measure(pairs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """q, b, d of pairs (q, b); ``asked``: q and its vector x."""
    def measure(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        d = _distances(_vectors(batch["x"]), _vectors(batch["y"]))
        return pa.RecordBatch.from_arrays([batch["q"], batch["b"], pa.array(d)], names=["q", "b", "d"])

    both = pairs.join(nodes.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").join(asked, "q")
    return map_batches(both, measure, "q long, b long, d double", 4000)


def greedy_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """q, b, d: the ``beam`` nearest nodes found for each query node (column ``q``)."""
    back = _closest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), DEGREE)
    edges = stored(graph.select("a", "b").union(back.select("a", "b")).distinct(), "edges")
    order = Window.partitionBy("q").orderBy("d", "b")
    asked = stored(nodes.select(F.col("node").alias("q"), F.col("v").alias("x")).join(queries, "q"), "query-vectors")
    entered = edges.join(queries, edges["a"] == queries["q"]).select("q", "b")
    pool = _measure(entered, nodes, asked).withColumn("expanded", F.lit(False))
    pool = pool.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= beam).drop("n")
    pool = stored(pool, "pool")
    for _ in range(steps):
        ahead = pool.filter("NOT expanded").select("q", F.col("b").alias("a"))
        if ahead.isEmpty():
            break
        heard = ahead.join(edges, "a").select("q", "b", F.lit(None).cast("double").alias("d")).filter("q <> b")
        unknown = heard.union(pool.select("q", "b", "d")).groupBy("q", "b").agg(F.max("d").alias("d")).filter("d IS NULL")
        new = _measure(unknown.select("q", "b"), nodes, asked).withColumn("expanded", F.lit(False))
        pool = pool.withColumn("expanded", F.lit(True)).union(new.select("q", "b", "d", "expanded"))
        pool = pool.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= beam).drop("n")
        pool = stored(pool, "pool")
    return pool.select("q", "b", "d")


def nearest_rows(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                 beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows found for the rows that ``queries`` marks: query_id, rank, id, score (distance)."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = (vectors.filter(usable(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), wide.alias("w"), queries.alias("is_query")))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [(np.asarray(x, np.float64) + 0.0).tobytes() for x in batch["w"].to_pylist()]  # -0.0 is 0.0
        return pa.RecordBatch.from_arrays([batch["id"], batch["is_query"], pa.array([len(x) // 8 for x in packed], pa.int32()),
                                           pa.array(packed, pa.binary())], names=["id", "is_query", "dim", "v"])

    rows = stored(map_batches(rows, pack, "id long, is_query boolean, dim int, v binary"), "vectors")
    rows_of = rows.groupBy("v", "dim").agg(F.min("id").alias("node"))

    def round_off(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [_rounded(np.frombuffer(x)[None])[0] for x in batch["v"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["node"], batch["dim"], batch["v"], pa.array(codes, pa.binary())],
                                          names=["node", "dim", "v", "code"])

    nodes = stored(map_batches(rows_of.select("node", "dim", "v"), round_off, "node long, dim int, v binary, code binary"), "nodes")
    copies = rows.join(nodes.select("v", "dim", "node"), ["v", "dim"]).select("node", "id", "is_query")
    copies = stored(copies, "copies")
    # a query needs no more than k + 1 rows of one vector: the smallest ids
    smallest = Window.partitionBy("node").orderBy("id")
    listed = (copies.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
              .select(F.col("node").alias("b"), "id"))
    asked = copies.filter("is_query").select(F.col("node").alias("q"), F.col("id").alias("query_id"))
    graph = build_graph(nodes, block=block)
    found = greedy_search(graph, nodes, stored(asked.select("q").distinct(), "query-nodes"), max(beam, k + 1))
    own = asked.select("q").distinct().select("q", F.col("q").alias("b"), F.lit(0.0).alias("d"))
    place = Window.partitionBy("query_id").orderBy("score", "id")
    return (asked.join(found.union(own), "q").join(listed, "b").filter("id <> query_id")
            .select("query_id", "id", F.col("d").alias("score"))
            .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
