"""JSONL transcripts in two dialects, read as text so that malformed lines cost only themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of the two dialects.
DIALECT_A = "type string, sessionId string, timestamp string, isCompactSummary boolean, compactMetadata string, message struct<content: array<struct<type: string, text: string, thinking: string, name: string, id: string, tool_use_id: string>>, model: string>, toolUseResult struct<stdout: string>"
DIALECT_B = "timestamp string, type string, payload struct<type: string, id: string, cwd: string>"


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(transcript, ord, line) of JSONL files (S5, S6): blank lines are left out; ord rises within a file."""
    raw = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("transcript"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return raw.where(F.length(F.trim("line")) > 0)


def parsed(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with the dialect (a, b or none), its fields, and what segmentation needs (S7, S8): ts, is_compaction, thinking.

    A line that is no JSON object has no dialect and is left to the caller.
    """
    a, b = F.from_json(line, DIALECT_A), F.from_json(line, DIALECT_B)
    out = rows.withColumn("a", a).withColumn("b", b)
    dialect = F.when(F.col("b.payload").isNotNull(), "b").when(F.col("a.message").isNotNull() | F.col("a.sessionId").isNotNull() | F.col("a.isCompactSummary").isNotNull(), "a")
    thoughts = F.size(F.filter(F.coalesce("a.message.content", F.array().cast("array<struct<type: string, text: string, thinking: string, name: string, id: string, tool_use_id: string>>")), lambda c: c["type"] == "thinking"))
    return out.withColumns(
        {
            "dialect": dialect,
            "ts": F.try_to_timestamp(F.coalesce("a.timestamp", "b.timestamp")),
            "is_compaction": F.coalesce(F.col("a.isCompactSummary"), F.col("b.type") == "compacted", F.lit(False)),
            "thinking": F.when(dialect == "a", thoughts).when(F.col("b.payload.type") == "agent_reasoning", 1).otherwise(0),
        }
    )


def tail(rows: DataFrame, n: int, transcript: str = "transcript", order: str = "ord") -> DataFrame:
    """The last n lines of each transcript."""
    from ..operators.relational import top_of

    return top_of(rows, [transcript], [F.desc(order)], n, "_n").drop("_n")


def tool_uses(rows: DataFrame) -> DataFrame:
    """(transcript, tool, calls, answered) of dialect A (T4, A21): results meet their calls by id; a result without a call is of no tool known."""
    parts = rows.where("dialect = 'a'").select("transcript", F.explode("a.message.content").alias("c"))
    calls = parts.where("c.type = 'tool_use'").select("transcript", F.col("c.id").alias("id"), F.col("c.name").alias("tool"))
    results = parts.where("c.type = 'tool_result'").select("transcript", F.col("c.tool_use_id").alias("id"), F.lit(1).alias("hit"))
    both = calls.join(results, ["transcript", "id"], "full")
    return both.groupBy("transcript", F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(F.count("tool").alias("calls"), F.count("hit").alias("answered"))
