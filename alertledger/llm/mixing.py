"""Mix sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each document of the source is then
taken 0, 1, ... ``max_copies`` times so that the source's taken words meet its
target. The expected number of copies is the same rate for all documents of a
source; its whole part is taken outright and the fractional part is rounded by
the pivotal method: two documents with fractional probabilities meet, words move
from one to the other (so that size x probability, summed, stays the same) until
one of the two probabilities is 0 or 1, and the other document goes on.

The meeting order is a tree: documents are dealt to buckets of about ``FAN`` by
hash, each bucket is folded to one undecided document, those are dealt to buckets
again, and so on until one document of each source is left, which is rounded at
random. A hot source is therefore many buckets, not one group. All random
numbers are hashes of the id, text, bucket level and ``seed``: reruns agree.

Defined results: NULL text has size 0; size-0 rows are taken 0 times; a NULL
source is a source of its own and sorts last; rows with equal id and text are
rounded one by one, as different documents; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, stored

FAN = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: float, max_copies: int) -> DataFrame:
    """source, n_docs, source_size, target: shares of ``total`` x all sizes by weight, each at most
    ``max_copies`` x its source, what is above shared out again.

    That process ends at min(cap, level x weight) for one common level. With the sources ordered by
    cap / weight, the level is that of the first source that does not reach its cap. The frame has one row
    per source, so its windows over all rows are small.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("w"), (F.col("source_size") * float(max_copies)).alias("cap"))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    goal = F.sum("source_size").over(everything) * float(total)
    per = per.select("*", ((goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("level"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))
    level = F.min(fits).over(everything)["level"]
    return per.select("source", "n_docs", "source_size",
                      F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _fold(level: int, seed: int) -> Column:
    """Fold the array ``docs`` of (size, hash, id, base, p), longest first: decided documents, the undecided one.

    Neighbours in size meet, so that long documents are decided early and a short one is left.
    """
    def decided(doc, p):
        return doc.withField("p", p)

    def meet(state, doc):
        one, two = state["open"], doc
        words = two["size"] / one["size"]
        up, down = F.least(1 - one["p"], two["p"] * words), F.least(one["p"], (1 - two["p"]) * words)
        rise = _unit(one["hash"], two["hash"], F.lit(level), F.lit(seed)) * (up + down) < down
        # p of both after the move; the one whose bound was reached gets exactly 0 or 1
        full = F.when(rise, 1 - one["p"] <= two["p"] * words).otherwise(one["p"] <= (1 - two["p"]) * words)
        p_one = F.when(full, rise.cast("double")).otherwise(
            F.when(rise, one["p"] + two["p"] * words).otherwise(one["p"] - (1 - two["p"]) * words))
        p_two = F.when(~full, (~rise).cast("double")).otherwise(
            F.when(rise, two["p"] - (1 - one["p"]) / words).otherwise(two["p"] + one["p"] / words))
        p_one, p_two = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) for p in (p_one, p_two))
        return F.struct(
            F.concat(state["done"], F.array(F.when(full, decided(one, p_one)).otherwise(decided(two, p_two)))).alias("done"),
            F.when(full, decided(two, p_two)).otherwise(decided(one, p_one)).alias("open"))

    docs = F.col("docs")
    first = F.struct(F.slice(docs, 1, 0).alias("done"), docs[0].alias("open"))
    return F.aggregate(F.slice(docs, F.lit(2), F.size(docs)), first, meet)


def mix_sources(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, max_copies: int = 2,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per input row: id, hash (of id, source and text), source, size, source_size, target, copies.

    Sources take ``weights`` in code point order (repeating) and share ``total`` x the words of all rows.
    """
    sizes = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                             word_count(F.col(text_col)).alias("size"),
                             F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(seed)).alias("hash")),
                   "mix-sizes")
    targets = stored(source_targets(sizes, weights, total, max_copies), "mix-targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0

    rate = F.col("target") / F.col("source_size")
    per_source = targets.filter("source_size > 0").select(
        F.col("source").alias("s"), F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"),
        F.ceil(F.col("n_docs") / FAN).alias("buckets"))
    doc = F.struct("size", "hash", "id", "base", "p")
    bucket = F.pmod(F.xxhash64("hash", F.lit("deal")), F.col("buckets"))
    left = (sizes.filter("size > 0").join(per_source, F.col("source").eqNullSafe(F.col("s")))
            .select("source", bucket.alias("bucket"), doc.alias("doc")))
    done, level, groups = [], 0, max(1, -(-most // FAN))
    while True:
        folded = stored(left.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("doc"), asc=False).alias("docs"))
                        .select("source", "bucket", _fold(level, seed).alias("f")), f"mix-level{level}")
        done.append(folded.select("source", F.explode("f.done").alias("doc")))
        left = folded.select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("f.open").alias("doc"))
        if groups == 1:
            break
        level, groups = level + 1, -(-groups // FAN)
    done.append(left.select("source", "doc"))

    taken = done[0]
    for part in done[1:]:
        taken = taken.unionByName(part)
    taken = taken.select("source", "doc.id", "doc.hash", "doc.size",
                         (F.col("doc.base") + F.round("doc.p")).cast("int").alias("copies"))
    taken = taken.unionByName(sizes.filter("size = 0").select("source", "id", "hash", "size", F.lit(0).alias("copies")))
    targets = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (taken.join(targets, F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("id").alias(id_col), "hash", F.col("source").alias(source_col), "size", "source_size",
                    "target", "copies"))


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: int = 17, **options) -> DataFrame:
    """The rows of the mix themselves: each input row as often as ``mix_sources`` takes it.

    Rows with equal id, source and text are one row here, repeated by the sum of their copies.
    """
    mixed = mix_sources(df, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    key, copies, nth = (fresh(df, name) for name in ("mix_hash", "mix_copies", "mix_nth"))
    taken = mixed.groupBy(F.col("hash").alias(key)).agg(F.sum("copies").alias(copies)).filter(F.col(copies) > 0)
    rows = df.withColumn(key, F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(seed)))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).filter(F.col(nth) == 1)
    return (rows.join(taken, key).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
            .select(*(F.col(f"`{c}`") for c in df.columns)))
