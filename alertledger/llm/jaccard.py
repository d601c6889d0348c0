"""Similarity join of documents on word n-gram sets, by set relations.

Two documents link when their sets of shingles have Jaccard similarity of at least
``percent`` / 100. Every linked pair shares a token in its prefixes (the rarest
tokens of each set, as many as the threshold needs), so an index of prefix tokens
finds all candidates. Rare tokens come first: their frequency class is taken from a
histogram of hash buckets over the whole corpus, whose size is fixed.

Relations between sets keep the index short:

* equal sets are one set;
* in every index list the most central set is the leader; a set that is verified to
  be similar to its best leader joins the leader's star, with its distance (size of
  the symmetric difference);
* in each list a star stands for its members, and components that are linked already
  are not compared again. List entries are skipped by size and position: a shared
  token at positions p, q leaves an overlap of at most min(p, q) + min(m - p, n - q);
* the answers of a star's members follow from the leader's: distances obey the
  triangle inequality, so two stars whose leaders are too far apart are skipped whole.
  Only stars that could still hold a link are compared member by member, a few
  members first, until the two components meet or all pairs have been tried;
* a sketch of a set has 256 bits, each the parity of the tokens that fall on it. The bits
  in which two sketches differ are at most the tokens in which the sets differ, so pairs
  of leaders and of members that are too far apart by their sketches are never made.

Components are therefore exact, while a family of thousands of near copies costs
about one comparison per copy. Shingles are 64-bit hashes.

Defined results: NULL or empty text (or white space alone) has an empty set and is
its own component; NULL ids stay; rows with equal ids are one row per input row;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import components, fresh, map_batches, ship, stored
from .hashing import shingles, word_hashes

BUCKETS = 1 << 17  # of the frequency histogram
TEXTS = 100  # that are hashed at once: a worker needs some 50 bytes for each of their bytes
SKETCH = 4  # words of 64 bits of a set's sketch
FIRST_TRIES = 6  # members of a star that a set near its leader is compared with first; later, all if need be


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    return [shingles(w, size) for w in word_hashes([t or b"" for t in column.cast(pa.binary()).to_pylist()])]


def _sid(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sketch(s: np.ndarray) -> np.ndarray:
    """``SKETCH`` words: the parity of the tokens that fall on each bit."""
    bits = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _apart(x: str, y: str) -> Column:
    """By two sketches, how many tokens their sets differ in at least."""
    return sum((F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(SKETCH)), F.lit(0))


def frequency_classes(texts: DataFrame, size: int) -> np.ndarray:
    """Class of every hash bucket: 0 for ordinary buckets, then by powers of two of the excess over the median."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BUCKETS, np.int64)  # of the whole task
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                for s in _sets(batch.slice(at, TEXTS)["text"], size):
                    own += np.bincount((s >> np.uint64(47)).astype(np.int64), minlength=BUCKETS) if len(s) > BUCKETS // 16 else 0
                    if 0 < len(s) <= BUCKETS // 16:
                        np.add.at(own, (s >> np.uint64(47)).astype(np.int64), 1)
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(own[used])], names=["bucket", "n"])

    totals = np.zeros(BUCKETS, np.int64)
    counts = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # BUCKETS rows at most
        totals[r["bucket"]] = r["n"]
    usual = float(np.median(totals))
    return np.log2(np.maximum(1, (totals - usual) / (3 * math.sqrt(usual) + 1))).astype(np.int8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _need(m: Column, n: Column, percent: int) -> Column:
    """Smallest overlap of sets of ``m`` and ``n`` tokens that link (times 100 + percent)."""
    return (m + n) * percent


def _fits(m: Column, n: Column, percent: int) -> Column:
    return (m * 100 >= n * percent) & (n * 100 >= m * percent)


def verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``pairs`` (a, b, ...) with ``common``: the size of the intersection of their sets, made from ``texts`` (sid, text).

    Texts travel, not sets: they are about half as large. Each side is joined with the texts of that side only.
    Up to 250,000 pairs (a few numbers each) are sent to the texts of the second side, which then travel once.
    """
    own = pairs.schema
    one = texts.filter("first").select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    two = texts.filter("second").select(F.col("sid").alias("b"), F.col("text").alias("text_b"))

    def intersect(batch: pa.RecordBatch) -> pa.RecordBatch:
        common = [len(np.intersect1d(x, y, assume_unique=True))
                  for x, y in zip(_sets(batch["text_a"], size), _sets(batch["text_b"], size), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch[f.name] for f in own), pa.array(common, pa.int64())],
                                          names=[*(f.name for f in own), "common"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    both = two.join(F.broadcast(pairs) if pairs.count() <= 250_000 else pairs, "b").join(one, "a")
    return stored(map_batches(both, intersect, f"{schema}, common long", TEXTS // 2), "verified")


def _links(verified: DataFrame, percent: int) -> DataFrame:
    linked = F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent
    return verified.filter(linked).select("a", "b")


def _side(stars: DataFrame, high: int, star: str, sid: str) -> DataFrame:
    """The first ``high`` members of each star, by the names of one side of a pair."""
    return stars.filter(F.col("rank") < high).select(
        F.col("star").alias(star), F.col("sid").alias(sid), F.col("n").alias(f"n{sid}"),
        F.col("d").alias(f"d{sid}"), F.col("rank").alias(f"r{sid}"), F.col("sketch").alias(f"s{sid}"))


class _Join:
    """The state of one join: sets, stars and links so far."""

    def __init__(self, texts: DataFrame, rows: DataFrame, size: int, percent: int):
        self.texts, self.rows, self.size, self.percent = texts, rows, size, percent
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """sid, text, first, second: a text of each set in ``pairs``, and on which side (a, b) it is."""
        sides = (pairs.select(F.col("a").alias("sid"), F.lit(True).alias("first"), F.lit(False).alias("second"))
                 .union(pairs.select("b", F.lit(False), F.lit(True)))
                 .groupBy("sid").agg(F.max("first").alias("first"), F.max("second").alias("second")))
        keys = stored(self.rows.join(sides, "sid").groupBy("sid", "first", "second").agg(F.min("row").alias("row")), "rows")
        small = keys.count() <= 500_000  # then it is sent to every executor and the texts are not shuffled
        return stored(self.texts.join(F.broadcast(keys) if small else keys, "row")
                      .select("sid", "text", "first", "second"), "texts")

    def add(self, links: DataFrame) -> None:
        self.links = stored(links if self.links is None else self.links.union(links), "links")
        self.comp = components(self.links)

    def with_component(self, df: DataFrame, sid: str, name: str) -> DataFrame:
        comp = self.comp.select(F.col("node").alias(sid), F.col("component").alias(name))
        return df.join(comp, sid, "left").withColumn(name, F.coalesce(name, sid))

    def star_members(self, star_pairs: DataFrame, stars: DataFrame, heads: DataFrame, high: int) -> DataFrame:
        """``star_pairs`` (l, k, distance) with those of the first ``high`` members a of l that could link with one of k.

        What the leader of k and the radius of k rule out is a condition of the join, so a large star makes rows only for
        members that are near enough, however many sets lie around it."""
        other = heads.select(F.col("star").alias("k"), F.col("radius").alias("rk"), F.col("n_min").alias("n0k"),
                             F.col("n_max").alias("n1k"), F.col("sketch").alias("sk"))
        least = F.greatest(F.col("distance") - F.col("da"), _apart("sa", "sk")) - F.col("rk")
        reach = least * (100 + self.percent) <= (F.col("na") + F.col("n1k")) * (100 - self.percent)
        fits = (F.col("na") * 100 >= F.col("n0k") * self.percent) & (F.col("n1k") * 100 >= F.col("na") * self.percent)
        return (star_pairs.join(other, "k").join(_side(stars, high, "l", "a"), "l").filter(reach & fits)
                .drop("rk", "n0k", "n1k", "sk"))

    def member_pairs(self, star_pairs: DataFrame, stars: DataFrame, heads: DataFrame, low: int, high: int) -> DataFrame:
        """Pairs (a, b, na, nb) of the first ``high`` members a side of pairs of stars (l, k, distance), without
        those among the first ``low``, and without those that the triangle inequality rules out."""
        least = F.greatest(F.col("distance") - F.col("da") - F.col("db"), _apart("sa", "sb"))
        reach = least * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent)
        new = (F.col("ra") >= low) | (F.col("rb") >= low)
        return (self.star_members(star_pairs, stars, heads, high).join(_side(stars, high, "k", "b"), "k")
                .filter(reach & new & _fits(F.col("na"), F.col("nb"), self.percent)).select("a", "b", "na", "nb"))

    def compare_members(self, star_pairs: DataFrame, stars: DataFrame, heads: DataFrame) -> None:
        """Compare members of pairs of stars (l, k, distance) until their components meet or all have been tried."""
        largest = stars.agg(F.max("members")).first()[0] or 0
        low, high, left = 0, FIRST_TRIES, star_pairs
        while True:
            tries = stored(self.member_pairs(left, stars, heads, low, high), "tries")
            if not tries.isEmpty():
                found = _links(verify(tries, self.texts_of(tries), self.size), self.percent)
                if not found.isEmpty():
                    self.add(found)
            if high >= largest:
                return
            low, high = high, high * 8
            left = self.with_component(self.with_component(left, "l", "cl"), "k", "ck").filter("cl <> ck").drop("cl", "ck")
            left = stored(left, "star-pairs")
            if left.isEmpty():
                return


def link_components(df: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links reach, its own included),
    row (hash of id and text) and class (hash that names the component; NULL for empty sets)."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = df.select(F.col(id_col).alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = frequency_classes(texts.select("text"), size)
    kind = df.schema[id_col].dataType.simpleString()

    def summarise(batch: pa.RecordBatch) -> pa.RecordBatch:
        sids, ns, prefixes, sketches = [], [], [], []
        for s in _sets(batch["text"], size):
            order = np.lexsort((s, classes[(s >> np.uint64(47)).astype(np.int64)]))
            sids.append(_sid(s))
            ns.append(len(s))
            sketches.append(_sketch(s))
            prefixes.append(s[order[:prefix_length(len(s), percent)]].view(np.int64) if len(s) else s.view(np.int64))
        words = [pa.array([x[i] for x in sketches], pa.int64()) for i in range(SKETCH)]
        return pa.RecordBatch.from_arrays(
            [batch["id"], batch["row"], pa.array(sids, pa.int64()), pa.array(ns, pa.int64()),
             pa.array(prefixes, pa.list_(pa.int64())), pa.StructArray.from_arrays(words, [f"w{i}" for i in range(SKETCH)])],
            names=["id", "row", "sid", "n", "prefix", "sketch"])

    words = ", ".join(f"w{i}: long" for i in range(SKETCH))
    rows = stored(map_batches(texts, summarise, f"id {kind}, row long, sid long, n long, prefix array<long>, sketch struct<{words}>",
                              TEXTS), "set-rows")
    sets = stored(rows.filter("n > 0").select("sid", "n", "sketch").dropDuplicates(["sid"]), "sets")
    join = _Join(texts, rows.select("row", "sid"), size, percent)

    entries = rows.filter("n > 0").select("sid", "n", F.posexplode("prefix").alias("p", "token"))
    lists = entries.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high")
    index = entries.join(stored(lists.select("token"), "shared-tokens"), "token")
    index = stored(index.dropDuplicates(["token", "sid"]), "index")  # lists of two sets or more

    # leaders: the set whose tokens are in the longest lists
    long_lists = index.join(index.groupBy("token").agg(F.count("*").alias("m")), "token")
    central = stored(index.join(long_lists.groupBy("sid").agg(F.sum("m").alias("score")), "sid"), "central")
    leader = central.groupBy("token").agg(F.max(F.struct("score", "sid", "n")).alias("lead"))
    votes = (central.join(leader, "token").filter("sid <> lead.sid")
             .groupBy(F.col("sid").alias("a"), F.col("lead.sid").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb"))
             .agg(F.count("*").alias("votes")))
    worth = (F.col("votes") * 4 * 100 >= F.col("na") * (100 - percent)) & _fits(F.col("na"), F.col("nb"), percent)
    best = (votes.filter(worth).groupBy("a").agg(F.max(F.struct("votes", "b", "na", "nb")).alias("x"))
            .select("a", "x.b", "x.na", "x.nb"))
    # beyond twice the distance of a link a leader's star hardly holds one; if it does, the lists of stars find it
    best = best.join(sets.select(F.col("sid").alias("a"), F.col("sketch").alias("sa")), "a") \
        .join(sets.select(F.col("sid").alias("b"), F.col("sketch").alias("sb")), "b") \
        .filter(_apart("sa", "sb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent) * 2).drop("sa", "sb")
    best = stored(best, "best-leaders")
    led = verify(best, join.texts_of(best), size).withColumn("d", F.col("na") + F.col("nb") - 2 * F.col("common"))
    led = led.withColumn("linked", F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)
    # a star: a leader and the sets that are linked to it; every other set is a star of its own
    member = led.filter("linked").select(F.col("a").alias("sid"), F.col("b").alias("star"), "d")
    known = index.select("sid").distinct().join(sets, "sid")
    stars = (known.join(member, "sid", "left")
             .select("sid", "n", "sketch", F.coalesce("star", "sid").alias("star"), F.coalesce("d", F.lit(0)).alias("d")))
    star_size = stars.groupBy("star").agg(F.count("*").alias("members"), F.max("d").alias("radius"),
                                          F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    star_size = stored(star_size, "star-sizes")
    rank = F.pmod(F.xxhash64("sid"), F.lit(1 << 30)) / float(1 << 30) * F.col("members")
    stars = stored(stars.join(star_size.select("star", "members"), "star").withColumn("rank", rank), "stars")
    heads = stored(star_size.join(sets.select(F.col("sid").alias("star"), "sketch"), "star"), "star-heads")
    # a set that is not similar to its best leader may be to some of the leader's star: a few are tried now
    near = led.filter("NOT linked").select(F.col("b").alias("l"), F.col("a").alias("k"), F.col("d").alias("distance"))
    tries = stored(join.member_pairs(near, stars, heads, 0, FIRST_TRIES), "tries")
    tried = verify(tries, join.texts_of(tries), size)
    join.add(led.filter("linked").select("a", "b").union(_links(tried, percent)))

    # lists of stars: pairs of different components that share a token
    of_star = star_size.select("star", "radius", F.col("n_min").alias("n0"), F.col("n_max").alias("n1"))
    entry = (index.join(stars.select("sid", "star"), "sid")
             .groupBy("token", "star").agg(F.max("p").alias("p1"), F.max(F.col("n") - F.col("p")).alias("rest"))
             .join(of_star, "star"))
    entry = stored(join.with_component(entry, "star", "comp"), "star-index")
    several = entry.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    entry = stored(entry.join(several.select("token"), "token"), "star-index")
    x = entry.select("token", *(F.col(c).alias(f"{c}_x") for c in ("star", "n0", "n1", "p1", "rest", "comp", "radius")))
    y = entry.select("token", *(F.col(c).alias(f"{c}_y") for c in ("star", "n0", "n1", "p1", "rest", "comp", "radius")))
    fits = (F.col("n1_x") * 100 >= F.col("n0_y") * percent) & (F.col("n1_y") * 100 >= F.col("n0_x") * percent)
    reach = (F.least("p1_x", "p1_y") + F.least("rest_x", "rest_y")) * (100 + percent) \
        >= _need(F.col("n0_x"), F.col("n0_y"), percent)
    met = (x.join(y, "token").filter((F.col("star_x") < F.col("star_y")) & (F.col("comp_x") != F.col("comp_y")) & fits & reach)
           .groupBy(F.col("star_x").alias("a"), F.col("star_y").alias("b"), "radius_x", "radius_y", "n0_x", "n0_y")
           .agg(F.count("*").alias("shared")))
    # stars of one set (radius 0): beyond the shared prefix tokens at most the rest of a set, without its prefix, can be common
    single = (F.col("radius_x") == 0) & (F.col("radius_y") == 0)
    rest = [F.ceil(F.col(n) * percent / 100) - 1 for n in ("n0_x", "n0_y")]
    possible = (F.col("shared") + F.greatest(*rest)) * (100 + percent) >= _need(F.col("n0_x"), F.col("n0_y"), percent)
    met = met.filter(~single | possible).select("a", "b")
    of_star = star_size.select("star", "radius", "n_max")
    met = (met.join(of_star.select(*(F.col(c).alias(f"{c}_x") for c in of_star.columns)), F.col("a") == F.col("star_x"))
           .join(of_star.select(*(F.col(c).alias(f"{c}_y") for c in of_star.columns)), F.col("b") == F.col("star_y"))
           .drop("star_x", "star_y"))
    met = (met.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
           .join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"))
    far = (_apart("sa", "sb") - F.col("radius_x") - F.col("radius_y")) * (100 + percent) \
        > (F.col("n_max_x") + F.col("n_max_y")) * (100 - percent)
    met = stored(met.filter(~far).drop("sa", "sb"), "star-pairs")
    if not met.isEmpty():
        met = verify(met, join.texts_of(met), size)
        found = _links(met, percent)
        if not found.isEmpty():
            join.add(found)
        distance = F.col("na") + F.col("nb") - 2 * F.col("common")
        within = (distance - F.col("radius_x") - F.col("radius_y")) * (100 + percent) \
            <= (F.col("n_max_x") + F.col("n_max_y")) * (100 - percent)
        open_ = met.filter("radius_x > 0 OR radius_y > 0").filter(within) \
            .select(F.col("a").alias("l"), F.col("b").alias("k"), distance.alias("distance"))
        open_ = join.with_component(join.with_component(open_, "l", "cl"), "k", "ck").filter("cl <> ck").drop("cl", "ck")
        open_ = stored(open_, "open-stars")
        if not open_.isEmpty():
            join.compare_members(open_, stars, heads)

    first = stored(join.with_component(rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("first")), "sid", "comp"), "first")
    smallest = first.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = first.join(smallest, "comp").select("sid", "component_id", F.col("comp").alias("class"))
    return (rows.select("id", "row", "sid", "n").join(named, "sid", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "row", "class"))


def one_of_each(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each class the row of smallest id stays. Empty texts all stay."""
    found = stored(link_components(df, size, percent, id_col, text_col)
                   .select(F.col(id_col).alias("id"), "row", "class"), "classes")
    stays = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = found.filter("class IS NOT NULL").groupBy("class").agg(stays.alias("kept"))
    row, nth = fresh(df, "copy_row"), fresh(df, "copy_nth")
    kept = kept.select(F.col("kept.row").alias(row), F.lit(True).alias(nth))
    empty = found.filter("class IS NULL").select(F.col("row").alias(row), F.lit(False).alias(nth)).distinct()
    rows = df.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col))).join(kept.union(empty), row)
    order = Window.partitionBy(row).orderBy(F.lit(0))
    return (rows.withColumn(nth, F.when(F.col(nth), F.row_number().over(order)).otherwise(1)).filter(F.col(nth) == 1)
            .select(*(F.col(f"`{c}`") for c in df.columns)))
