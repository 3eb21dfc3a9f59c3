"""Queries of the subpackage and, where SQL can state them, the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import exact, jaccard, language, licences, mixing, packing, preferences, spelling, suffixes, toxicity, vectors, whitening
from fluxloom.llm.common import documents


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_top_k": lambda spark, sf_dir: vectors.top_k(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0),
    "op2_mix_sources": lambda spark, sf_dir: mixing.mix_report(documents(spark, sf_dir)),
    "op3_embedding_near_duplicates": lambda spark, sf_dir: vectors.near_duplicates(embeddings(spark, sf_dir)),
    "op4_suffix_dedup": lambda spark, sf_dir: suffixes.repeat_report(documents(spark, sf_dir)),
    "op5_jaccard_join": lambda spark, sf_dir: jaccard.near_copies(documents(spark, sf_dir)),
    "op6_language": lambda spark, sf_dir: language.language_report(documents(spark, sf_dir)),
    "op7_preferences": lambda spark, sf_dir: preferences.preference_report(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op8_licences": lambda spark, sf_dir: licences.scan(documents(spark, sf_dir)),
    "op9_pack_documents": lambda spark, sf_dir: packing.pack_documents(documents(spark, sf_dir)),
    "op10_toxicity": lambda spark, sf_dir: toxicity.toxicity_report(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ),
    "op11_exact_dedup": lambda spark, sf_dir: exact.duplicate_report(documents(spark, sf_dir)),
    "op12_spelling_variants": lambda spark, sf_dir: spelling.spelling_report(documents(spark, sf_dir)),
    "op13_whitening": lambda spark, sf_dir: whitening.whiten(embeddings(spark, sf_dir)),
}
ORACLES: dict[str, str] = {
    "op1_vector_top_k": vectors.TOP_K_SQL,
    "op2_mix_sources": mixing.MIX_SQL,
    "op3_embedding_near_duplicates": vectors.NEAR_SQL,
    "op7_preferences": preferences.PREFERENCE_SQL,
    "op8_licences": licences.licence_sql(),
    "op11_exact_dedup": exact.DUPLICATE_SQL,
    "op12_spelling_variants": spelling.SPELLING_SQL,
}
