"""Joins over commits, files, sessions and services that plain equality cannot express, rewritten as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from .writes import require_none


def pair_counts(baskets: DataFrame, basket: str, item: str, smallest: int = 2, largest: int = 50, least: int = 2) -> DataFrame:
    """(item_a, item_b, weight): unordered pairs of items by the baskets that hold both.

    Baskets outside the size bounds do not count; the upper bound also bounds the pairs that a basket makes.
    """
    distinct = baskets.select(basket, item).distinct()
    size = distinct.groupBy(basket).agg(F.collect_list(item).alias("items")).where(F.size("items").between(smallest, largest))
    items = size.select(basket, F.array_sort("items").alias("items"))
    pairs = items.select(basket, "items", F.posexplode("items").alias("k", "item_a")).select("item_a", F.explode(F.slice("items", F.col("k") + 2, F.greatest(F.size("items") - F.col("k") - 1, F.lit(0)))).alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def prefixes(path: Column) -> Column:
    """All prefixes of a path that end at a slash boundary, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def suffixes(path: Column) -> Column:
    """All suffixes of a path that start after a slash, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def longest_prefix(files: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """files with the longest root that holds them, else null (J10, G23): an equi-join over path prefixes and a maximum.

    Found by path and not by row, so that it does not matter in which order rows are read a second time.
    """
    hit = files.select(path).distinct().select(path, F.explode(prefixes(F.col(path))).alias(root)).join(roots.select(root).distinct(), root)
    best = hit.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return files.join(best, path, "left").select(*files.columns, root)


def suffix_matches(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Distinct (a, b) of paths where one ends with the other at a slash."""
    l, r = left.select(a).distinct(), right.select(b).distinct()
    ends = l.select(a, F.explode(suffixes(F.col(a))).alias("_k")).join(r.withColumn("_k", F.col(b)), "_k")
    starts = r.select(b, F.explode(suffixes(F.col(b))).alias("_k")).join(l.withColumn("_k", F.col(a)), "_k")
    return ends.select(a, b).unionByName(starts.select(a, b)).distinct()


def _days(start: Column, end: Column) -> Column:
    day = lambda t: F.datediff(t.cast("date"), F.lit("1970-01-01"))
    return F.sequence(day(start), day(end))


def within(points: DataFrame, at: str, spans: DataFrame, start: Column, end: Column, keys: list[str]) -> DataFrame:
    """Points and the spans that hold them (J17, J18): an equi-join on keys and days, then the exact bounds."""
    cut = spans.withColumn("_start", start).withColumn("_end", end).where("_end >= _start").select("*", F.explode(_days(F.col("_start"), F.col("_end"))).alias("_day"))
    dated = points.withColumn("_day", F.datediff(F.col(at).cast("date"), F.lit("1970-01-01")))
    return dated.join(cut, [*keys, "_day"]).where(F.col(at).between(F.col("_start"), F.col("_end"))).drop("_day", "_start", "_end")


def latest_holder(points: DataFrame, point: str, at: str, spans: DataFrame, span: str, start: Column, end: Column, keys: list[str]) -> DataFrame:
    """(point, span): the span of the latest start that holds each point; ties to the smallest span."""
    hit = within(points, at, spans.withColumn("_from", start), start, end, keys)
    return hit.groupBy(point).agg(F.min(F.struct((-F.unix_micros(F.col("_from").cast("timestamp"))).alias("s"), F.col(span).alias("v"))).alias("m")).select(point, F.col("m.v").alias(span))


def prefix_matches(short: DataFrame, a: str, full: DataFrame, b: str, size: int = 7) -> DataFrame:
    """(a, b, n): full hashes that a short one starts, and how many there are (J19, S4): bucketed by the first characters.

    Short ones of fewer than `size` characters are refused.
    """
    require_none(short.where(F.length(a) < size), f"a hash of fewer than {size} characters")
    l = short.select(a, F.substring(a, 1, size).alias("_k"))
    r = full.select(b, F.substring(b, 1, size).alias("_k"))
    hit = l.join(r, "_k").where(F.col(b).startswith(F.col(a))).drop("_k").distinct()
    return hit.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(a)))


def owners(claims: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, owner, ambiguous): who claims a name; null and ambiguous if more than one does."""
    g = claims.groupBy(name).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner))
    return g.select(name, F.when(F.col("_n") == 1, F.col(owner)).alias(owner), (F.col("_n") > 1).alias("ambiguous"))


def route_matches(pattern: Column, path: Column) -> Column:
    """Whether a path fits a route (J24): {} one part, {**} one part or more."""
    quoted = F.regexp_replace(pattern, r"([.\\+*?\[^\]$()=!<>|:#-])", r"\\$1")
    # the quoted forms of {**} and {}
    expr = F.replace(F.replace(quoted, F.lit(r"{\*\*}"), F.lit(".+")), F.lit("{}"), F.lit("[^/]+"))
    return F.rlike(path, F.concat(F.lit("^"), expr, F.lit("$")))


def linked_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls(call_id, service, method, path) with endpoint_id and status linked, ambiguous or unresolved.

    An exact method is preferred to ANY; what is left after that must be one endpoint.
    """
    e = endpoints.select("endpoint_id", "service", F.col("method").alias("_m"), F.col("path").alias("_p"))
    hit = calls.join(e, "service").where(((F.col("_m") == F.col("method")) | (F.col("_m") == "ANY")) & route_matches(F.col("_p"), F.col("path")))
    hit = hit.withColumn("_rank", F.when(F.col("_m") == F.col("method"), 1).otherwise(2))
    best = hit.groupBy("call_id").agg(F.min("_rank").alias("_best"))
    picked = hit.join(best, "call_id").where("_rank = _best").groupBy("call_id").agg(F.count_distinct("endpoint_id").alias("_n"), F.min("endpoint_id").alias("endpoint_id"))
    out = calls.join(picked, "call_id", "left")
    return out.select(*calls.columns, F.when(F.col("_n") == 1, F.col("endpoint_id")).alias("endpoint_id"), F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "ambiguous").otherwise("linked").alias("status"))


def commit_summaries(commits: DataFrame, key: str, files: DataFrame, notes: DataFrame) -> DataFrame:
    """commits with sums of files(key, additions, deletions) and notes(key, note) (J11): each side is aggregated before it is joined."""
    f = files.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    n = notes.groupBy(key).agg(F.array_sort(F.collect_set("note")).alias("notes"))
    return commits.join(f, key, "left").join(n, key, "left").withColumns({"files": F.coalesce("files", F.lit(0)), "notes": F.coalesce("notes", F.array().cast("array<string>"))})


#: Rows of one side in a piece of a group that is multiplied out, and how many of the other side's meet it at once.
PIECE, FEW = 1 << 10, 4


def _marked(rows: DataFrame, key: str, text: str, mark: str) -> tuple[DataFrame, DataFrame]:
    """(key, mark) of rows(key, text), where keys with the same set of texts have the same mark, and (mark, text) once for each mark."""
    rows = settled(rows.where(F.col(text).isNotNull()).select(key, text).distinct())
    both = F.struct(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64(text, F.lit(k))) for k in (1, 2)])  # of a set: in any order
    marks = settled(rows.groupBy(key).agg(both.alias("_set")).select(key, F.sha2(F.to_json("_set"), 256).alias(mark)))
    of = marks.groupBy(mark).agg(F.min(key).alias(key))
    return marks, rows.join(of, key).select(mark, text).distinct()


def _pieces(rows: DataFrame, key: str, mark: str) -> DataFrame:
    """(mark, part_key, keys): the keys of each mark in arrays of about PIECE."""
    sizes = rows.groupBy(mark).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / PIECE)).alias(f"_part_{key}")
    return rows.join(sizes, mark).select(mark, key, part).groupBy(mark, f"_part_{key}").agg(F.collect_list(key).alias(f"_all_{key}"))


def all_pairs(left: DataFrame, a: str, right: DataFrame, b: str, texts: DataFrame) -> DataFrame:
    """Distinct (a, b) of left(a, said) and right(b, text) by texts(said, text), each pair once and none of them shuffled.

    The pairs may be as many as the square of the rows; so equal sets of texts stand for all rows that have them until the last step, which
    multiplies pieces of a few rows with one another, spread evenly.  texts: which distinct said meet which distinct text.
    """
    spark = left.sparkSession
    own, of_own = _marked(left, a, "said", "_own")
    met, of_met = _marked(of_own.join(texts, "said"), "_own", "text", "_met")
    l = own.join(met, "_own").select(a, "_met")
    r = of_met.join(right, "text").select("_met", b).distinct()
    units = _pieces(l, a, "_met").join(_pieces(r, b, "_met"), "_met")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    units = units.repartition(parts, "_met", f"_part_{a}", f"_part_{b}")
    few = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"_all_{a}") - 1) / FEW).cast("int")), lambda k: F.slice(f"_all_{a}", k * FEW + 1, FEW))
    # Spark holds all pairs that one row makes within a stage of generated code, a million for two pieces; coalesce moves no row and begins a new stage
    units = units.select(F.explode(few).alias(f"_all_{a}"), f"_all_{b}").coalesce(parts)
    return units.select(F.explode(f"_all_{a}").alias(a), f"_all_{b}").select(a, F.explode(f"_all_{b}").alias(b))


def glob_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of claims (a.id, a.glob; b.id, b.glob) whose fixed prefixes hold one another (J22): equi-joins over prefixes of characters.

    A glob's fixed prefix ends before its first wildcard.
    """
    head = lambda g: F.regexp_extract(g, r"^[^*?\[{]*", 0)
    starts = lambda h: F.transform(F.sequence(F.lit(0), F.length(h)), lambda n: F.substr(h, F.lit(1), n))
    l, r = a.select(F.col("id").alias("id_a"), head(F.col("glob")).alias("said")), b.select(F.col("id").alias("id_b"), head(F.col("glob")).alias("text"))
    said, text = l.select("said").distinct(), r.select("text").distinct()
    one = said.select("said", F.explode(starts(F.col("said"))).alias("text")).join(text, "text").select("said", "text")
    two = text.select("text", F.explode(starts(F.col("text"))).alias("said")).join(said, "said").select("said", "text")
    return all_pairs(l, "id_a", r, "id_b", one.unionByName(two))


def remapped(commits: DataFrame, key: str, rewrites: DataFrame) -> DataFrame:
    """commits under their new hashes (W26): rewrites(old_hash, new_hash); a null new hash drops the commit."""
    r = rewrites.select(F.col("old_hash").alias(key), F.col("new_hash"), F.lit(True).alias("_moved"))
    return commits.join(r, key, "left").where("_moved is null or new_hash is not null").withColumn(key, F.coalesce("new_hash", key)).drop("new_hash", "_moved")


#: What may be a hash, whole or short.
HASH = "^[0-9a-fA-F]{7,40}$"


def _translated(rows: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(_k, id, field, value, old_hash, new_hash) of rows(id, field, value) whose value is a hash, or the first 7 characters or more of one; _k: its first 7."""
    short = rows.where(F.col("value").rlike(HASH)).select("id", "field", "value", F.lower("value").alias("_v")).withColumn("_k", F.substring("_v", 1, 7))
    return short.join(rewrites.select("old_hash", "new_hash", F.substring("old_hash", 1, 7).alias("_k")), "_k").where(F.startswith("old_hash", F.col("_v"))).drop("_v")


def _sources(rewrites: DataFrame, commits: DataFrame, prior: DataFrame) -> DataFrame:
    """rewrites with the commit that each old hash has been (_source) and the one that holds its new hash (_target)."""
    was = commits.select(F.col("commit_hash").alias("old_hash"), F.col("id").alias("_now"))
    before = prior.select("old_hash", F.col("commit_id").alias("_prior"))
    there = commits.select(F.col("commit_hash").alias("new_hash"), F.col("id").alias("_target"))
    out = rewrites.join(was, "old_hash", "left").join(before, "old_hash", "left").join(there, "new_hash", "left")
    return out.withColumn("_source", F.coalesce("_now", "_prior")).drop("_now", "_prior")


def remap_problems(commits: DataFrame, rewrites: DataFrame, findings: DataFrame, prior: DataFrame) -> DataFrame:
    """(problem, id, field, value, n): why a rewrite of history(old_hash, new_hash) may not be taken over.

    ambiguous: a hash of findings(id, field, value) is short and starts n old hashes; collision: a new hash already is another
    commit's (n 1).  commits(id, commit_hash), prior(old_hash, commit_id) are former rewrites.
    """
    return _refused(_translated(findings, rewrites), _sources(rewrites, commits, prior))


def _refused(met: DataFrame, sources: DataFrame) -> DataFrame:
    # a value's rows have met by _k, so counting them by _k as well moves none
    ambiguous = met.groupBy("_k", "id", "field", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("ambiguous").alias("problem"), "id", "field", "value", "n")
    taken = sources.where("new_hash <> old_hash and _source is not null and _target is not null and _target <> _source")
    return ambiguous.unionByName(taken.select(F.lit("collision").alias("problem"), F.col("_source").alias("id"), F.lit("commit_hash").alias("field"), F.col("new_hash").alias("value"), F.lit(1).cast("long").alias("n")))


def remap_history(commits: DataFrame, rewrites: DataFrame, findings: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, findings, prior) after a rewrite of history (W26), or an error with none of them changed.

    Commits move to their new hashes; pruned ones (no new hash) keep theirs.  Findings' hashes, short ones too, become the whole new hash.  prior
    gets or keeps a row for each old hash whose commit is known, with its new hash (null: pruned).
    """
    sources = settled(_sources(rewrites, commits, prior))
    require_none(_refused(_translated(findings, rewrites), sources), "the rewrite is refused")
    moved = rewrites.where("new_hash <> old_hash").select(F.col("old_hash").alias("commit_hash"), "new_hash")
    new_commits = commits.join(moved, "commit_hash", "left").select(*[F.coalesce("new_hash", "commit_hash").alias(c) if c == "commit_hash" else F.col(c) for c in commits.columns])
    # each hash meets one rewrite at most, or it had been refused; what is no hash stays where it is
    named = F.coalesce(F.col("value").rlike(HASH), F.lit(False))
    new = moved.select(F.col("commit_hash").alias("_old"), "new_hash", F.substring("commit_hash", 1, 7).alias("_k"))
    short = findings.where(named).withColumn("_k", F.substring(F.lower("value"), 1, 7)).alias("s").join(new.alias("n"), (F.col("s._k") == F.col("n._k")) & F.startswith("_old", F.lower("value")), "left")
    new_findings = short.select(*[F.coalesce("new_hash", "value").alias(c) if c == "value" else F.col(f"s.{c}") for c in findings.columns]).unionByName(findings.where(~named))
    told = sources.where(~F.col("new_hash").eqNullSafe(F.col("old_hash"))).select("old_hash", F.coalesce("_source", "_target").alias("commit_id"), "new_hash").where("commit_id is not null")
    kept = prior.select("old_hash", "commit_id", *(["new_hash"] if "new_hash" in prior.columns else [F.lit(None).cast("string").alias("new_hash")])).join(told.select("old_hash"), "old_hash", "left_anti")
    return new_commits, new_findings, kept.unionByName(told)
