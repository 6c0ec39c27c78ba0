"""Budgeted rendering: what of a result fits a number of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_or_headlines(rows: DataFrame, text: str, most_rows: int = 3, most_chars: int = 6000) -> DataFrame:
    """One row: whether a result may be shown in full (B1)."""
    return rows.agg(((F.count(F.lit(1)) <= most_rows) & (F.coalesce(F.sum(F.length(text)), F.lit(0)) <= most_chars)).alias("full"))


def fitting(rows: DataFrame, group: list[str], order: list[Column], text: str, budget: int, pointer: int = 0) -> DataFrame:
    """The longest prefix of each group's rows within the budget (B2, B8, N7): each row costs its length and a newline; a pointer is
    reserved where rows are left over."""
    w = Window.partitionBy(*group).orderBy(*order)
    used = rows.withColumn("used", F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = used.withColumn("_all", F.max("used").over(Window.partitionBy(*group)))
    room = F.when(F.col("_all") <= budget, budget).otherwise(budget - pointer)
    return whole.where(F.col("used") <= room).drop("_all")


#: Kinds of pages and what each is called.
PAGES = {"synthesis": "Review synthesis", "finding": "Finding", "share": "Shared detail", "idea": "Idea"}
SHORTENED = "… [metadata shortened]"
NUDGE_SHORTENED = "… [nudge shortened; read the board and the claims]"


def _one_line(text: Column, size: int, marker: str) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, max(0, size - len(marker))), F.lit(marker)))


def compact_nudge(text: Column, reserve: int = 512) -> Column:
    """A notice that goes beside a page, in one line within its reserve of characters."""
    return _one_line(text, reserve - 2, NUDGE_SHORTENED)


def pages(rows: DataFrame, keys: list[str], prefix: Column, body: str, kind: str, budget: int, pointer: Callable[[Column], Column]) -> DataFrame:
    """(keys, part, total_parts, body_part, text): bodies cut into pages that all fit the budget.

    pointer(part) is what a reader asks for next.  How much of a body a page has room for depends on the pointer's length, that on the
    number of pages, and that on the room: the number is raised until it is its own result, within each row.  Lengths are in characters;
    an empty body has one page; a pointer that leaves no room is an error.
    """
    if budget < 256:
        raise ValueError("a budget of fewer than 256 characters has no room for pages")
    label, separator, end = PAGES[kind], 2, f"\n-- end {kind}-body --"
    frame = lambda n: F.concat(F.lit(f"-- {kind}-body chars="), F.lpad(n.cast("string"), 10, "0"), F.lit(" --\n"))
    cut = rows.select(*keys, _one_line(prefix, min(1000, budget // 4), SHORTENED).alias("_prefix"), F.coalesce(body, F.lit("")).alias("_body"))
    fixed = F.length("_prefix") + 2 * separator + len(f"-- {kind}-body chars=0000000000 --\n") + len(end)
    said = lambda part, total, what: F.concat(F.lit(f"_{label} part "), part.cast("string"), F.lit("/"), total.cast("string"), F.lit("; "), what, F.lit("._"))
    worst = lambda t: F.length(said(t, t, F.concat(F.lit("next: "), pointer(t))))

    def step(acc, _):
        room = F.lit(budget) - fixed - worst(acc["total"])
        size = F.when(room > 0, room).otherwise(F.raise_error(F.lit("a page's pointer exceeds the budget")).cast("int"))
        total = F.greatest(F.lit(1), F.ceil(F.length("_body") / size).cast("int"))
        fits = total == acc["total"]
        return F.when(acc["size"] > 0, acc).otherwise(F.struct(F.when(fits, acc["total"]).otherwise(total).alias("total"), F.when(fits, size).otherwise(0).alias("size")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(1).alias("total"), F.lit(0).alias("size")), step)
    sized = cut.withColumn("_f", found).withColumn("_f", F.when(F.col("_f.size") > 0, F.col("_f")).otherwise(F.raise_error(F.lit("pages did not settle")).cast("struct<total: int, size: int>")))
    parts = F.transform(F.sequence(F.lit(1), F.col("_f.total")), lambda p: F.struct(p.alias("part"), F.substring(F.col("_body"), (p - 1) * F.col("_f.size") + 1, F.col("_f.size")).alias("body_part")))
    each = sized.select(*keys, "_prefix", F.col("_f.total").alias("total_parts"), F.inline(parts))
    tail = F.when(F.col("part") < F.col("total_parts"), F.concat(F.lit("next: "), pointer(F.col("part") + 1))).otherwise("complete")
    text = F.concat(F.col("_prefix"), F.lit("\n\n"), frame(F.length("body_part")), F.col("body_part"), F.lit(end + "\n\n"), said(F.col("part"), F.col("total_parts"), tail))
    return each.select(*keys, "part", "total_parts", "body_part", text.alias("text"))


def headlines_shown(rows: DataFrame, group: list[str], order: list[Column], full: str, line: str, heading: Column, noun: str, narrowing: str, budget: int, most_rows: int = 3, most_chars: int = 6000) -> DataFrame:
    """(group, total, shown, text): each group's answer within a budget.

    Few and short rows are shown in full; else as many headlines, from the first on, as fit together with a pointer that says
    how many there are and how long all of it would be.  The first that does not fit ends it, as the pointer grows with what is shown.
    A group's rows are cut to what could fit at all before they are put in order, so a group of any size is no burden on a task.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), (F.sum(F.length(full) + 1) - 1).alias("chars"), F.min(heading).alias("_heading"))
    w = Window.partitionBy(*group).orderBy(*order)
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget)
    shown_full = (F.col("total") <= most_rows) & (F.col("chars") <= F.least(F.lit(most_chars), F.lit(budget)))
    pointer = lambda n: F.concat(F.lit("_"), n.cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(f" {noun} headline"), F.when(F.col("total") == 1, "").otherwise("s"), F.lit(" shown; complete render "), F.col("chars").cast("string"), F.lit(f" chars. To read omitted headlines or bodies, {narrowing}._"))
    head = F.when(F.length("_heading") > 0, F.length("_heading") + 1).otherwise(0)
    both = top.join(sizes, group)
    running = both.withColumn("_used", head + F.sum(F.length(line) + 1).over(Window.partitionBy(*group).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    fails = running.where(~shown_full & (F.col("_used") + 2 + F.length(pointer(F.col("_n"))) > budget)).groupBy(*group).agg(F.min("_n").alias("_stop"))
    kept = running.join(fails, group, "left").where(shown_full | F.col("_stop").isNull() | (F.col("_n") < F.col("_stop")))
    texts = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("shown"), F.array_sort(F.collect_list(F.struct("_n", F.when(shown_full, F.col(full)).otherwise(F.col(line)).alias("t")))).alias("_l"))
    out = sizes.join(texts, group, "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    body = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    headed = F.when(F.length("_heading") > 0, F.concat(F.col("_heading"), F.lit("\n"), body)).otherwise(body)
    text = F.when(shown_full, body).when(F.col("shown") > 0, F.concat(headed, F.lit("\n\n"), pointer(F.col("shown")))).when(F.length("_heading") > 0, F.concat(F.col("_heading"), F.lit("\n\n"), pointer(F.lit(0)))).otherwise(pointer(F.lit(0)))
    fit = shown_full | (F.length(text) <= budget)
    return out.select(*group, "total", F.col("shown").cast("long").alias("shown"), F.when(fit, text).otherwise(F.raise_error(F.lit("the pointer exceeds the budget")).cast("string")).alias("text"))


def headline(text: Column, size: int = 120) -> Column:
    """One line with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def largest_remainder(sections: DataFrame, weight: str, budget: int, order: str) -> DataFrame:
    """Whole shares of a budget in proportion to weights (B6); what is left goes by remainder, ties by order.  A few rows by nature."""
    total = F.sum(weight).over(Window.partitionBy(F.lit(1)))
    exact = F.when(total > 0, F.lit(budget) * F.col(weight) / total).otherwise(F.lit(0.0))
    cut = sections.withColumn("_exact", exact).withColumn("_base", F.floor("_exact").cast("long"))
    left = cut.withColumn("_left", F.when(F.sum(weight).over(Window.partitionBy(F.lit(1))) > 0, F.lit(budget) - F.sum("_base").over(Window.partitionBy(F.lit(1)))).otherwise(F.lit(0)))
    ranked = left.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 9)), order)))
    return ranked.withColumn("share", F.col("_base") + (F.col("_n") <= F.col("_left")).cast("long")).drop("_exact", "_base", "_left", "_n")


def allocate(wants: list[int], floors: list[int], budget: int) -> list[int]:
    """Characters for each section (B6, B7): floors for those that want any, the rest in proportion to what is still wanted, what is left by
    largest remainder, then whatever spills over to the first that can use it."""
    out = [min(w, f) if w else 0 for w, f in zip(wants, floors, strict=True)]
    if sum(out) > budget:
        raise ValueError("the floors exceed the budget")
    rest = budget - sum(out)
    need = [w - o for w, o in zip(wants, out, strict=True)]
    if (total := sum(need)) and rest:
        give = min(rest, total)
        share = [give * n / total for n in need]
        whole = [int(s) for s in share]
        by_rest = sorted(range(len(need)), key=lambda k: (-(share[k] - whole[k]), k))
        for k in by_rest[: give - sum(whole)]:
            whole[k] += 1
        for k, s in enumerate(whole):
            out[k] += min(s, need[k])
        left = give - sum(min(s, n) for s, n in zip(whole, need, strict=True))
        for k in range(len(need)):
            more = min(left, wants[k] - out[k])
            out[k], left = out[k] + more, left - more
    return out


def sections(parts: list[tuple[str, DataFrame]], text: str, order: str) -> DataFrame:
    """Sections as one table (B3): (section, place, ord, text)."""
    out = None
    for n, (name, df) in enumerate(parts):
        s = df.select(F.lit(name).alias("section"), F.lit(n).alias("place"), F.col(order).cast("long").alias("ord"), F.col(text).alias("text"))
        out = s if out is None else out.unionByName(s)
    return out
