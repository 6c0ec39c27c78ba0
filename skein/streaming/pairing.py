"""Tool calls and their results as two streams that meet (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(calls: DataFrame, results: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(transcript, id, tool, called_at, answered_at, output, status) of calls(transcript, id, tool, at) and results(transcript, id, at, output).

    A result answers the call of its id in its transcript if it comes no earlier and within the time allowed.  Repeated
    calls and results count once, the first that is seen.  status: answered; lost, for a call whose time has passed; stray, for a
    result whose call has not come by then.  Lost and stray ones are told when the watermark says so; what comes later than
    `late` is dropped.  Batch tables do as well: what is open at their end is lost or stray.
    """
    c, r = calls.select("transcript", "id", "tool", "at"), results.select("transcript", "id", "at", "output")
    if calls.isStreaming or results.isStreaming:
        c = c.withWatermark("at", late).dropDuplicatesWithinWatermark(["transcript", "id"])
        r = r.withWatermark("at", late).dropDuplicatesWithinWatermark(["transcript", "id"])
    else:
        c = c.groupBy("transcript", "id").agg(F.min(F.struct("at", "tool")).alias("m")).select("transcript", "id", "m.*")
        r = r.groupBy("transcript", "id").agg(F.min(F.struct("at", "output")).alias("m")).select("transcript", "id", "m.*")
    c, r = (d.select(*[F.col(x).alias(f"{x}_{s}") for x in d.columns]) for d, s in ((c, "c"), (r, "r")))
    meets = (F.col("transcript_c") == F.col("transcript_r")) & (F.col("id_c") == F.col("id_r")) & (F.col("at_r") >= F.col("at_c")) & (F.col("at_r") <= F.col("at_c") + F.expr(f"interval {within}"))
    both = c.join(r, meets, "fullOuter")
    status = F.when(F.col("id_c").isNull(), "stray").when(F.col("id_r").isNull(), "lost").otherwise("answered")
    return both.select(F.coalesce("transcript_c", "transcript_r").alias("transcript"), F.coalesce("id_c", "id_r").alias("id"), F.col("tool_c").alias("tool"), F.col("at_c").alias("called_at"), F.col("at_r").alias("answered_at"), F.col("output_r").alias("output"), status.alias("status"))
