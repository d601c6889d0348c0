"""Registered queries of this subpackage: ``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, conversations, copies, extraction, inner_product, jaccard, lines, mixing, neighbours, packing, repeats, secrets, toxicity
from .common import stored, table


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    """Chain of low quality, then toxic, trained on the labelled ``documents`` of a folder."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category and the verdict on every row of ``documents``."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir))
    return scored.withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer products with all ``embeddings`` for each row whose vec_id is divisible by 50."""
    return inner_product.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all ``embeddings`` found for each row whose vec_id is divisible by 100."""
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed with weights 3, 1, 2 to 150 % of their words."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "source")


def op5_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    out = extraction.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all ``documents`` covered by repeated 400-byte strings, removed."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all ``documents`` that repeat an earlier line, up to the edits of its length: how many go, and what is left."""
    marked = lines.mark_duplicate_lines(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                         F.size("drop_lines").cast("long").alias("n_removed"),
                         F.sha2(lines.without_lines(F.col("text"), F.col("drop_lines")), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` linked by Jaccard similarity of 0.85 of their 4-word shingles."""
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row of its text that stays."""
    return copies.exact_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of each language of ``documents``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of ``conversations``, rebuilt with shared beginnings."""
    turns, convs = conversations.ordered_turns(table(spark, sf_dir, "conversations"))
    rebuilt = stored(conversations.with_shared_beginnings(turns, convs), "trie-input")
    return conversations.prefix_trie(rebuilt, convs)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_top_products, op3_nearest, op4_mix_sources, op5_extract_text, op6_remove_repeats, op7_line_dedup, op8_jaccard_join, op9_pack, op10_secret_scan, op11_exact_dedup, op12_collocations, op13_conversation_trie)}
