"""Ordered picks, paging and set differences over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order (A10, W4); the order must be total for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_of(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def numbered(df: DataFrame, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """Row numbers in an order, over all rows or by key."""
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0, total: str = "total") -> DataFrame:
    """A page whose rows carry the count of all rows (N2): one number, counted apart from the page."""
    n = df.count()
    page = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    return page.withColumn(total, F.lit(n).cast("long"))


def sentinel_page(df: DataFrame, order: list[Column], limit: int, flag: str = "capped") -> DataFrame:
    """A page of `limit` rows and whether there are more (L3): one row more is fetched, never the rest."""
    w = Window.orderBy(*order)
    more = df.orderBy(*order).limit(limit + 1).withColumn("_n", F.row_number().over(w))
    return more.withColumn(flag, F.max("_n").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_n") <= limit).drop("_n")


def after(df: DataFrame, columns: list[str], values: list, limit: int, descending: bool = False) -> DataFrame:
    """The page after a key (P15, P16, L5): the comparison is written out so that its first part reaches the scan."""
    cond, equal = None, None
    for c, v in zip(columns, values, strict=True):
        step = (F.col(c) < F.lit(v)) if descending else (F.col(c) > F.lit(v))
        step = step if equal is None else equal & step
        cond = step if cond is None else cond | step
        equal = (F.col(c) == F.lit(v)) if equal is None else equal & (F.col(c) == F.lit(v))
    return df.where(cond).orderBy(*[F.desc(c) if descending else F.asc(c) for c in columns]).limit(limit)


def merged(parts: list[DataFrame], order: list[Column], limit: int) -> DataFrame:
    """The first rows of several sorted sources (L7): each source is cut before they meet."""
    cut = [p.orderBy(*order).limit(limit) for p in parts]
    out = cut[0]
    for p in cut[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order).limit(limit)


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the other table."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def next_ordinal(df: DataFrame, group: list[str], column: str, name: str = "next") -> DataFrame:
    """The next number of each group."""
    return df.groupBy(*group).agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias(name))


def scoped(df: DataFrame, project: str, column: str = "project", globals_too: bool = False) -> DataFrame:
    """Rows of one project, and those of none if asked for."""
    own = F.col(column) == project
    return df.where(own | F.col(column).isNull() if globals_too else own)


def optional(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the parameters that are given."""
    for c, v in values.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A limit within its bounds (P20)."""
    return default if value is None else max(low, min(high, int(value)))
