"""Order-aware segmentation of transcripts."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS, CEILING = 24 * 3600, 150


def gap_segments(entries: DataFrame, transcript: str, order: str, at: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """entries with a segment number (T1, time rule): a gap of at least the bound starts a new one.

    File order decides, not time; an entry without a time does not move the last one, and going back in time never splits.
    """
    w = Window.partitionBy(transcript).orderBy(order)
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    split = F.coalesce((micros(F.col(at)) - micros(before) >= gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return entries.withColumn("_split", split).withColumn("segment", F.sum("_split").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_split")


class Fold:
    """The state of one transcript: feed entries in file order, get segment numbers.

    A gap or a compaction marker opens a segment, as does an entry that would lift the running count of thoughts above the
    ceiling; the opening entry belongs to the new segment, and nothing opens before the first entry.
    """

    def __init__(self, gap_seconds: int = GAP_SECONDS, ceiling: int = CEILING, state: tuple | None = None):
        self.gap, self.ceiling = gap_seconds, ceiling
        self.segment, self.count, self.last, self.begun = state or (0, 0, None, False)

    def feed(self, at: float | None, compaction: bool, thoughts: int) -> int:
        """at: seconds, or none."""
        late = self.begun and at is not None and self.last is not None and at - self.last >= self.gap
        if self.begun and (late or compaction or self.count + thoughts > self.ceiling):
            self.segment, self.count = self.segment + 1, 0
        self.count += thoughts
        self.begun = True
        if at is not None:
            self.last = at
        return self.segment

    @property
    def state(self) -> tuple:
        return self.segment, self.count, self.last, self.begun


def seconds(at: datetime | None) -> float | None:
    import pandas as pd

    return None if at is None or pd.isna(at) else pd.Timestamp(at).timestamp()


def folded(entries: Iterable[tuple[float | None, bool, int]], **bounds) -> list[int]:
    f = Fold(**bounds)
    return [f.feed(*e) for e in entries]


def _in_order(entries: DataFrame, transcript: str, order: str, micros: Column, marker: Column, weight: Column, gap_seconds: float, ceiling: int) -> DataFrame:
    """(transcript, ord, segment): each transcript's rows, sorted, pass through one fold a batch at a time; a task holds no transcript."""
    kind = dict(entries.dtypes)

    def run(batches):
        of, f = None, None
        for b in batches:
            out = []
            for t, at, mark, n in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if f is None or t != of:
                    of, f = t, Fold(gap_seconds, ceiling)
                out.append(f.feed(None if at is None else at / 1e6, bool(mark), n or 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [transcript, order, "segment"])

    rows = entries.select(transcript, order, micros.alias("_at"), marker.alias("_mark"), weight.cast("long").alias("_n"))
    return rows.repartition(transcript).sortWithinPartitions(transcript, order).mapInArrow(run, f"{transcript} {kind[transcript]}, {order} {kind[order]}, segment int")


def segments(entries: DataFrame, transcript: str = "transcript", order: str = "ord", gap_seconds: int = GAP_SECONDS, ceiling: int = CEILING) -> DataFrame:
    """(transcript, ord, segment) by all three rules (T1): entries(transcript, ord, ts, is_compaction, thinking).

    The counter depends on earlier splits, so a transcript is folded in order; transcripts are spread by hash.
    """
    return _in_order(entries, transcript, order, F.unix_micros(F.col("ts").cast("timestamp")), F.coalesce("is_compaction", F.lit(False)), F.col("thinking"), gap_seconds, ceiling)


def by_ceiling(entries: DataFrame, transcript: str, order: str, weight: str, ceiling: int) -> DataFrame:
    """(transcript, ord, segment) by the ceiling alone (T1, count rule)."""
    return _in_order(entries, transcript, order, F.lit(None).cast("long"), F.lit(False), F.col(weight), GAP_SECONDS, ceiling)
