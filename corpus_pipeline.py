"""A training corpus from raw documents: five stages, each an operator of ``fluxloom.llm``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of
``documents``; only the last returns packed pieces. ``run`` writes each stage's result to the shared folder
and reads it back, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import jaccard, mixing, packing, suffixes, toxicity
from fluxloom.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine takes for toxic go. It learns from the labels of four fifths of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.harmless(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one of the smallest id stays."""
    return jaccard.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur elsewhere are cut out; texts that this leaves empty go."""
    sized = docs.withColumn("n_chars", F.struct("n_chars", (F.length("text") > 0).alias("filled")))
    cut = suffixes.remove_repeats(sized).where((F.length("text") > 0) | ~F.coalesce("n_chars.filled", F.lit(False)))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars.n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the mixture's weights, documents repeated as often as drawn."""
    return mixing.emitted(mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of 4096."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can state neither the kernel machine nor the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
