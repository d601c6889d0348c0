"""Prefix trie of conversations by digests of fixed-length blocks of turns.

Every turn has a digest of its place and content; the digest of a run of turns is the exclusive or of theirs (128
bits), so digests of blocks compose to those of beginnings, and no task reads a long conversation whole.

1. Conversations are cut into blocks of ``BLOCK`` turns and grouped by the digest of all earlier blocks and of the
   block itself: who agrees in both agrees up to the end of the block.
2. Where all that share the earlier blocks share the next one too, its turns are nodes with these members, and one
   conversation's turns stand for them. Only where siblings diverge inside a block are its turns compared, by the
   digest of each beginning.
3. A node's subtree is summed through its members: what a node adds is noted at its smallest member, each
   conversation sums what is noted at and after each of its turns, and a node adds that up over its members. So the
   depth of the trie costs no rounds.

Everything is combined in each task before it is shuffled; where rows need the values of a group, groups of at
least a ten-thousandth of all rows are sent to every task (``spread_join``).

Defined results: turns are in the order of turn (NULL first), then role, then text; NULL role or text is empty;
rows without conversation id take no part; repeated rows are turns of their own; a table without
conversations has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import numbered, ship, spread_join, stored

BLOCK = 8
WIDTH = 512      # blocks of a conversation that one window runs over
ID_CHUNK = 4096  # ids of members that are put in order together


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, pos from 1, content, bytes) of all turns, and (conv, turns) of the conversations.

    Rows are dealt by ranges of conversation and order, so a long conversation is in many tasks (``numbered``).
    """
    rows = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in (("role", role_col), ("text", text_col))))
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    start = [F.substring(c, 1, 64) for c in ("role", "text")]  # keys of ranges go to the driver: no whole texts
    placed = numbered(rows, "conv", ["turn", *start], ["turn", "role", "text"], "trie-turns",
                      ["conv", content.alias("content"), F.octet_length("text").cast("long").alias("bytes")])
    placed = stored(placed.withColumnRenamed("_place", "pos"), "trie-places")
    return placed.drop("_rows"), placed.filter("pos = 1").select("conv", F.col("_rows").alias("turns"))


def with_shared_beginnings(turns: DataFrame, convs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Turns of conversations rebuilt: the first h turns of the conversation whose id is the next lower multiple of ``family``
    (all if it has fewer, none if it is not there), then the conversation's own turns after its first h.

    h is the CRC-32 of the decimal id modulo ``most`` + 1.
    """
    def h(conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % (most + 1)

    heads = turns.filter((F.pmod("conv", F.lit(family)) == 0) & (F.col("pos") <= most)).withColumnRenamed("conv", "base")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("head"))
    base = F.col("conv") - F.pmod("conv", F.lit(family))
    convs = stored(convs.withColumn("base", base).withColumn("h", h(F.col("conv"))).join(lengths, "base", "left")
                   .withColumn("head", F.least(F.coalesce("head", F.lit(0)), "h")), "trie-rebuilt")
    begun = convs.select("conv", "base", "h").join(heads, "base").filter("pos <= h").select(*turns.columns)
    own = spread_join(turns, convs.select("conv", "h", "head", "turns"), ["conv"], "turns").filter("pos > h")
    return begun.unionByName(own.withColumn("pos", F.col("pos") - F.col("h") + F.col("head")).select(*turns.columns))


def _before(df: DataFrame, index: str, xors: dict[str, str], sums: dict[str, str], width: int) -> DataFrame:
    """``df`` (stored; conv, index, values) with the values of the rows of its conversation with smaller index, combined.

    ``xors`` and ``sums`` map a value to the name of its result. No window holds more than ``width`` rows.
    """
    def combined(window, names: dict[str, str], combine) -> dict[str, Column]:
        return {new: F.coalesce(combine(F.col(old)).over(window), F.lit(0).cast("long")) for old, new in names.items()}

    upper, name = F.floor(F.col(index) / width).cast("long"), f"{index}_upper"
    window = Window.partitionBy("conv", name).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(name, upper).withColumns(combined(window, xors, F.bit_xor) | combined(window, sums, F.sum))
    if (df.agg(F.max(index)).first()[0] or 0) < width:
        return inside.drop(name)
    totals = stored(df.groupBy("conv", upper.alias(name)).agg(*(F.bit_xor(c).alias(c) for c in xors), *(F.sum(c).alias(c) for c in sums)), "trie-upper")
    earlier = _before(totals, name, {c: f"{name}_{c}" for c in xors}, {c: f"{name}_{c}" for c in sums}, width).drop(*xors, *sums)
    both = inside.join(earlier, ["conv", name])
    both = both.withColumns({new: F.col(new).bitwiseXOR(F.col(f"{name}_{old}")) for old, new in xors.items()}
                            | {new: F.col(new) + F.col(f"{name}_{old}") for old, new in sums.items()})
    return both.select(*df.columns, *xors.values(), *sums.values())


def _running(turns: Column, field: str, end: Column) -> Column:
    return F.aggregate(F.slice(turns, 1, end), F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[field]))


_PARENT = ["block", "p1", "p2"]
_GROUP = [*_PARENT, "d1", "d2", "size"]
_NODE = ["depth", "k1", "k2"]


def _nodes(rows: DataFrame, *more: str) -> DataFrame:
    """One row a turn of ``rows`` (p1, p2, turns): the node's key, the turn's own digest and bytes, and ``more``."""
    t = F.explode(F.transform(F.col("turns"), lambda t, i: F.struct(
        t["pos"].alias("depth"),
        F.col("p1").bitwiseXOR(_running(F.col("turns"), "e1", i + 1)).alias("k1"),
        F.col("p2").bitwiseXOR(_running(F.col("turns"), "e2", i + 1)).alias("k2"),
        t["e1"].alias("e1"), t["e2"].alias("e2"), t["bytes"].alias("bytes"))))
    return rows.select(t.alias("t"), *more).select("t.*", *more)


def _noted(rows: DataFrame) -> DataFrame:
    """One row a turn of ``rows`` (p1, p2, turns, notes, after, leaves_after): what is noted at and after it."""
    def rest(field: str) -> Column:
        notes = F.filter(F.coalesce("notes", F.array().cast(rows.schema["notes"].dataType)), lambda x: x["depth"] >= F.col("depth"))
        return F.aggregate(notes, F.lit(0).cast("long"), lambda s, x: s + x[field])

    return _nodes(rows, "notes", "after", "leaves_after").select(
        *_NODE, (F.col("after") + rest("saves")).alias("saved_tokens"), (F.col("leaves_after") + rest("leaf")).alias("n_leaves"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv, pos from 1 without gaps, content, bytes) of the conversations ``convs`` (conv)."""
    def digest(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("pos"), F.col("content"))

    turn = F.struct("pos", digest(1).alias("e1"), digest(2).alias("e2"), "bytes")
    blocks = (turns.groupBy("conv", F.floor((F.col("pos") - 1) / block).cast("long").alias("block"))
              .agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    blocks = stored(blocks.select("*", *(_running(F.col("turns"), e, F.size("turns")).alias(d) for d, e in (("d1", "e1"), ("d2", "e2"))),
                                  F.size("turns").alias("size")), "trie-blocks")
    placed = stored(_before(blocks, "block", {"d1": "p1", "d2": "p2"}, {}, width), "trie-prefixes")

    # who shares all earlier blocks: one kind of next block, or several
    siblings = stored(placed.groupBy(*_GROUP).agg(F.count("*").alias("n")).groupBy(*_PARENT)
                      .agg(F.sum("n").alias("n"), (F.count("*") == 1).alias("calm")), "trie-siblings")
    placed = stored(spread_join(placed, siblings, _PARENT, "n").drop("n"), "trie-split")
    same = (placed.filter("calm").groupBy(*_GROUP)
            .agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("turns").alias("turns")))
    calm = _nodes(same, "n_convs", "conv_id")
    refined = _nodes(placed.filter("NOT calm"), "conv").groupBy(*_NODE).agg(
        *(F.first(c).alias(c) for c in ("e1", "e2", "bytes")), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in (*_NODE, "e1", "e2", "bytes")), "n_convs", "conv_id")
    nodes = stored(calm.unionByName(refined).unionByName(root), "trie-nodes")

    up = [F.col("depth") - 1, F.col("k1").bitwiseXOR(F.col("e1")), F.col("k2").bitwiseXOR(F.col("e2"))]
    below = nodes.filter("depth > 0").withColumns(dict(zip(("up0", "up1", "up2"), up, strict=True)))
    children = below.groupBy(*(F.col(u).alias(k) for u, k in zip(("up0", "up1", "up2"), _NODE, strict=True))).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")
    parents = nodes.filter("n_children > 0").select(
        *(F.col(k).alias(u) for u, k in zip(("up0", "up1", "up2"), _NODE, strict=True)), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parent_of = stored(spread_join(below.select(*_NODE, "up0", "up1", "up2"), stored(parents, "trie-parents"), ["up0", "up1", "up2"], "n_children")
                       .select(*_NODE, "parent_conv_id"), "trie-parent-of")

    # what each node adds is noted at its smallest member, and summed over members
    note = F.struct("depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    notes = (nodes.filter("depth > 0").groupBy(F.col("conv_id").alias("conv"), F.floor((F.col("depth") - 1) / block).cast("long").alias("block"))
             .agg(F.collect_list(note).alias("notes"), F.sum(note["saves"]).alias("saves"), F.sum(note["leaf"]).alias("leaf")))
    last = placed.agg(F.max("block")).first()[0] or 0
    noted = stored(placed.join(notes, ["conv", "block"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("saves", "leaf")} | {"back": F.lit(last) - F.col("block")}), "trie-notes")
    noted = stored(_before(noted, "back", {}, {"saves": "after", "leaf": "leaves_after"}, width), "trie-sums")
    calm_sums = noted.filter("calm").groupBy(*_GROUP).agg(
        F.first("turns").alias("turns"), F.first("notes", ignorenulls=True).alias("notes"),  # one member has the notes
        F.sum("after").alias("after"), F.sum("leaves_after").alias("leaves_after"))
    sums = _noted(calm_sums).unionByName(_noted(noted.filter("NOT calm")).groupBy(*_NODE).agg(
        F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves")))
    whole = nodes.agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"))
    sums = sums.unionByName(whole.filter("n_leaves IS NOT NULL").select(*(zero.alias(c) for c in _NODE), "saved_tokens", "n_leaves"))

    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, _NODE).join(parent_of, _NODE, "left").join(_ends(placed, convs), _NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def _ends(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node at which conversations end: the hash of their ids, read in order in chunks of at most ID_CHUNK ids."""
    last = placed.groupBy("conv").agg(F.max(F.struct(
        F.col("turns")[F.size("turns") - 1]["pos"].alias("depth"), F.col("p1").bitwiseXOR(F.col("d1")).alias("k1"),
        F.col("p2").bitwiseXOR(F.col("d2")).alias("k2"))).alias("node"))
    zero = F.lit(0).cast("long")
    at = convs.select("conv").join(last, "conv", "left").select("conv", *(F.coalesce(f"node.{k}", zero).alias(k) for k in _NODE))
    ids = F.sort_array(F.collect_list("conv"))
    chunks = at.groupBy(*_NODE, F.floor(F.col("conv") / ID_CHUNK).cast("long").alias("chunk")).agg(
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch[c].to_pylist() for c in (*_NODE, "ids")), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield _ended(done)
        if now is not None:
            yield _ended([(*now, state.hexdigest())])

    ship(placed.sparkSession)
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(tasks, *_NODE).sortWithinPartitions(*_NODE, "chunk").select(*_NODE, "ids")
    return stored(dealt.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string"), "trie-ends")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())],
                                      [*_NODE, "ends_sha256"])
