"""Curation: what is aged and never cited, what graduates, recounts, queues and reports.  `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_before(now: str, days: int) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def aged(df: DataFrame, created: str, baseline: str, now: str, days: int = 90) -> DataFrame:
    """Rows whose later of creation and baseline is older than the floor."""
    return df.where(F.greatest(F.col(created), F.coalesce(baseline, created)) < days_before(now, days))


def candidates(rows: DataFrame, kept: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Never-cited rows(id, created_at, baseline_at, cited_count) that were not kept(id, resolved_at) within the window."""
    recent = kept.where(F.col("resolved_at") >= days_before(now, days)).select("id")
    return aged(rows.where("cited_count = 0"), "created_at", "baseline_at", now, days).join(recent, "id", "left_anti")


def graduates(rows: DataFrame, open_: DataFrame, least: int = 5) -> DataFrame:
    """Rows relearned often enough, of a project, without an open proposal."""
    return rows.where((F.col("relearned_count") >= least) & F.col("project").isNotNull()).join(open_.select("id"), "id", "left_anti")


def recounted(rows: DataFrame, citations: DataFrame, cited: str = "cited_id") -> DataFrame:
    """Counters from the facts (W21): cited_count and last_cited_at of each row."""
    c = citations.groupBy(F.col(cited).alias("id")).agg(F.count(F.lit(1)).alias("cited_count"), F.max("created_at").alias("last_cited_at"))
    return rows.drop("cited_count", "last_cited_at").join(c, "id", "left").withColumn("cited_count", F.coalesce("cited_count", F.lit(0)))


def violation_summary(recent: DataFrame) -> DataFrame:
    """Violations by kind with those recovered (A19), over rows that are already limited."""
    return recent.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("recovered")).alias("recovered"))


def strict_total(rows: DataFrame, value: str, order: str, key: str, group: str) -> DataFrame:
    """Sums in which a missing value makes the total null (A20): the last row of each key counts."""
    last = rows.groupBy(group, key).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(group).agg(F.when(F.count_if(F.col("_v").isNull()) == 0, F.sum("_v")).alias("total"), F.count(F.lit(1)).alias("requests"))


def open_notes(notes: DataFrame) -> DataFrame:
    """The latest note of each thread and author."""
    return notes.groupBy("thread", "author").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def without_repeats(rows: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """Rows whose key is not that of the row before (A20): a cumulative value that was reported again."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(key))).drop("_b")
