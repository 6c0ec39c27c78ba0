"""Stages of the corpus pipeline.  All but the last return the columns of documents.

Rows without a doc_id cannot be named by results keyed by it: the stages for near-duplicates and contamination name
them by their texts for the while, by numbers above all others; the other stages judge every row by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, quality, sentencepiece, simhash, suffix_dedup
from .common import read_table, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others come through as they are, null texts and repeated rows too."""
    return quality.scored(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def named(docs: DataFrame) -> DataFrame:
    """The columns of documents and `key`: doc_id, or else a number of 2^62 and more from the text."""
    of_text = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), of_text).alias("key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest doc_id (rows without one come last).

    Rows of one doc_id and one text are one document, of which one row stays; those of one doc_id and other texts all do.
    """
    rows = named(docs)
    keep = stored(simhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct())
    return rows.join(keep, "key", "left_semi").dropDuplicates(["key", "text"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of a smaller doc_id are cut out; bytes of characters cut in two go with them.  A null text becomes empty."""
    out = suffix_dedup.deduplicate(docs.select(*COLUMNS), texts="kept_text", carry=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, all rows of such a doc_id."""
    rows = named(docs)
    hit = stored(decontamination.contaminated(rows.select(F.col("key").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct())
    return rows.join(hit, "key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each remaining text, and whether they decode to it.  Rows are encoded as often as they come; a null text has no ids."""
    return sentencepiece.round_trip(docs)


STAGES = [
    ("quality", good_quality),
    ("simhash", near_duplicates),
    ("suffix", repeated_passages),
    ("benchmark", no_benchmark),
    ("sentencepiece", encode),
]
