"""Incremental operators as Structured Streaming: late duplicates, open segments, claims that expire, boards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.segments import CEILING, GAP_SECONDS, Fold, seconds


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Rows not seen before within the time that data may be late (T6): the state of older keys is dropped at the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


class Segmenter(StatefulProcessor):
    """The fold of one transcript, kept between batches (T1, T2): earlier segments never change as a file grows."""

    def __init__(self, gap_seconds: int = GAP_SECONDS, ceiling: int = CEILING):
        self.bounds = gap_seconds, ceiling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "segment int, count int, last double, begun boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        f = Fold(*self.bounds, state=tuple(self.state.get()) if self.state.exists() else None)
        segment = [f.feed(seconds(t), bool(c), int(n or 0)) for t, c, n in zip(pdf["ts"], pdf["is_compaction"], pdf["thinking"], strict=True)]
        self.state.update(f.state)
        yield pd.DataFrame({"transcript": key[0], "ord": pdf["ord"], "segment": segment})

    def close(self) -> None:
        pass


def segmented(stream: DataFrame, gap_seconds: int = GAP_SECONDS, ceiling: int = CEILING) -> DataFrame:
    """(transcript, ord, segment) of a stream of entries(transcript, ord, ts, is_compaction, thinking) in file order.  Needs the RocksDB state store."""
    return stream.groupBy("transcript").transformWithStateInPandas(Segmenter(gap_seconds, ceiling), "transcript string, ord long, segment int", "append", "none")


def live_claims(claims: DataFrame, now: str, hours: int = 8) -> DataFrame:
    """Claims with their state at a moment (T8, W32, Z13, Z5): active, or expired where the heartbeat is older than the hours allowed."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return claims.withColumn("status", F.when((F.col("status") == "active") & (F.col("heartbeat_at") < limit), "expired").otherwise(F.col("status")))


def fresh_messages(messages: DataFrame, marks: DataFrame, me: str) -> DataFrame:
    """Messages since the reader's mark in own threads or open handoffs (T7): messages(id, thread, author, kind, status, created_at), marks(reader, seen_at)."""
    mark = marks.where(F.col("reader") == me).agg(F.max("seen_at").alias("seen_at")).first()["seen_at"]
    new = messages.where(F.col("author") != me)
    new = new if mark is None else new.where(F.col("created_at") > F.lit(mark))
    own = messages.where(F.col("author") == me).select("thread").distinct().withColumn("own", F.lit(True))
    return new.join(own, "thread", "left").where("own or (kind = 'handoff' and status = 'open')").drop("own")


def unread_files(found: DataFrame, ingested: DataFrame) -> DataFrame:
    """Files not yet read at their present time (T10): found(path, mtime) without ingested(path, mtime)."""
    return found.join(ingested.select("path", "mtime"), ["path", "mtime"], "left_anti")


def resume_points(found: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, action, from_offset) for files against their marks (T2): nothing newer is unchanged, a shrunken file is read anew, else from the open segment."""
    m = marks.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), "open_start_offset")
    out = found.join(m, "path", "left")
    action = F.when(F.col("_m").isNull(), "new").when(F.col("mtime") <= F.col("_m"), "unchanged").when(F.col("size") < F.col("_s"), "restart").otherwise("resume")
    return out.select("path", action.alias("action"), F.when(action == "resume", F.col("open_start_offset")).when(action == "unchanged", None).otherwise(F.lit(0)).cast("long").alias("from_offset"))


def appended(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """A stream into a table by batches (W33, Z21, T9, T11): `write` must be safe to repeat for a batch number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
