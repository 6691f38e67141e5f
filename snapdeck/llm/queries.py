"""One query per corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdeck.llm.centroid_clustering import cluster, with_inertia
from snapdeck.llm.common import remainder, text_of
from snapdeck.llm.decontaminate import decontaminate
from snapdeck.llm.exact_dedup import exact_dedup
from snapdeck.llm.importance_resampling import resample
from snapdeck.llm.jaccard_join import jaccard_components
from snapdeck.llm.line_dedup import line_dedup
from snapdeck.llm.lm_scoring import lm_scores
from snapdeck.llm.packing import pack
from snapdeck.llm.quality import classify
from snapdeck.llm.source_mixing import mix_sources
from snapdeck.llm.substring_dedup import substring_dedup
from snapdeck.llm.token_counts import token_counts
from snapdeck.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(text_of("text"), 256)}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), remainder("_id", 4) != 2)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"), stats=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of("text"), 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(_table(spark, sf_dir, "embeddings"))
    return with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_best_fit_packing, op3_quality_classifier, op4_ngram_jaccard_join, op5_url_filters, op6_lm_scoring,
    op7_substring_dedup, op8_line_dedup, op9_benchmark_decontamination, op10_token_counts, op11_centroid_clustering,
    op12_importance_resampling, op13_source_mixing, pipeline)}
