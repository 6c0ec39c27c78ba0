"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length (a partial aggregate, so the shuffle holds one row per length and
task).  Suffix sums over the histogram answer, for each length L taken as a context limit: the documents and
tokens at or beyond it, the total after truncation to L, and the quantile of L.  The suffix sums are made in
two levels (blocks of lengths, then within a block), so no task sees the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Lengths in one block of the suffix sums.
BLOCK = 256


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(length, n_docs) of a table of lengths; null lengths are not counted."""
    return lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per length L: what a context limit of L means for the corpus.

    length, n_docs, docs_at_least, tokens_at_least (suffix sums), total_tokens, truncated_total (each document
    counts min(length, L)), fits (documents of length <= L), quantile (fits / documents).  Between two lengths of the
    histogram the truncated total grows by docs_at_least of the upper one per token, so the rows answer every
    limit (see truncated_total).  An empty table gives no rows.
    """
    hist = stored(hist.withColumn("block", F.floor(F.col("length") / BLOCK)))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    totals = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n_docs") * F.col("length")), F.lit(0)).alias("t")).first()
    all_docs, total_tokens = F.lit(totals["n"]), F.lit(totals["t"])
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    d = (F.sum("n_docs").over(within) + F.col("d_above")).alias("docs_at_least")
    t = (F.sum(F.col("n_docs") * F.col("length")).over(within) + F.col("t_above")).alias("tokens_at_least")
    rows = hist.join(blocks, "block").select("block", "length", "n_docs", d, t)
    return rows.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        total_tokens.alias("total_tokens"),
        (total_tokens - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_total"),
        (all_docs - F.col("docs_at_least") + F.col("n_docs")).alias("fits"),
        ((all_docs - F.col("docs_at_least") + F.col("n_docs")) / all_docs).alias("quantile"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens that remain when each document is cut to `limit`, from the rows of limits()."""
    low = table.where(F.col("length") >= limit).orderBy("length").select("total_tokens", "tokens_at_least", "docs_at_least").first()
    if low is None:
        top = table.select("total_tokens").first()
        return top[0] if top else 0
    return low[0] - low[1] + low[2] * limit
