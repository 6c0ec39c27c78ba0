"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, bpe, decontamination, embedding_dedup, html_text, lm_scoring, merkle, quality, sentencepiece, simhash, suffix_dedup, token_counts, url_filter
from .common import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded and compared."""
    return sentencepiece.round_trip(read_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return lm_scoring.score(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without repeated passages."""
    return suffix_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items."""
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and quantiles at every context limit, from the encoded lengths of all documents."""
    return token_counts.limits(token_counts.histogram(sentencepiece.lengths(read_table(spark, sf_dir, "documents"))))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and audit of every document."""
    return merkle.audit(read_table(spark, sf_dir, "documents"), merkle.without_newlines())


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector."""
    return ball_kmeans.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_lm_scoring, op4_suffix_dedup, op5_embedding_dedup, op6_decontamination, op7_token_counts, op8_html_text, op9_quality, op10_simhash, op11_merkle_manifest, op12_bpe, op13_ball_kmeans)}
ORACLES: dict[str, str] = {"op11_merkle_manifest": merkle.SQL}
