"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, class_lm, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, suffix_dedup, toxicity, url_filters
from millrace.llm.common import read_documents
from millrace.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), keep_ids=False)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(read_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_documents(spark, sf_dir))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(read_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(read_documents(spark, sf_dir))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_opening_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return suffix_dedup.remove_repeats(read_documents(spark, sf_dir)).select(
        "doc.doc_id",
        F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_summary(read_documents(spark, sf_dir))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_class_lm": op4_class_lm,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_alignment": op13_alignment,
}
