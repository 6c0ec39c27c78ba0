"""Text formats of version control: logs, name lists, status and commit maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Marks of a log's entries; a message that holds one spoils its own entry only.
COMMIT, BODY, END = "@@ENTRY@@", "@@BODY@@", "@@ENDBODY@@"


def name_only_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, file) of a name-only log (S12): a line of 40 hex digits heads the files that follow.

    Each file is one task's whole text, so lines keep their order; the header of a line is carried by a running maximum of positions.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), F.split("value", "\r?\n").alias("lines"))
    return named_files(text)


def named_files(logs: DataFrame) -> DataFrame:
    """(commit, file) of logs(log, lines)."""
    rows = logs.select("log", F.posexplode("lines").alias("k", "line")).where(F.length(F.trim("line")) > 0)
    head = F.col("line").rlike("^[0-9a-f]{40}$")
    w = Window.partitionBy("log").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("commit", F.last(F.when(head, F.col("line")), ignorenulls=True).over(w))
    return at.where(~head & F.col("commit").isNotNull()).select("commit", F.col("line").alias("file"))


def renamed(path: Column) -> tuple[Column, Column]:
    """Old and new path of a rename as git abbreviates it (S11): a/{b => c}/d, or a => b; else twice the path."""
    braces = r"^(.*)\{(.*) => (.*)\}(.*)$"
    plain = r"^(.*) => (.*)$"
    clean = lambda p: F.regexp_replace(p, "//+", "/")
    side = lambda n: F.when(path.rlike(braces), clean(F.concat(F.regexp_extract(path, braces, 1), F.regexp_extract(path, braces, n + 1), F.regexp_extract(path, braces, 4)))).when(path.rlike(plain), F.regexp_extract(path, plain, n)).otherwise(path)
    return side(1), side(2)


def numstat(line: Column) -> dict[str, Column]:
    """Fields of a numstat line (S11): additions and deletions (null for binary files), old and new path."""
    part = lambda k: F.regexp_extract(line, r"^(\d+|-)\t(\d+|-)\t(.+)$", k)
    old, new = renamed(part(3))
    return {"additions": part(1).try_cast("int"), "deletions": part(2).try_cast("int"), "is_binary": part(1) == "-", "old_path": old, "path": new}


def log_command(repo: str, since: str | None = None, every: bool = False) -> list[str]:
    """The command that prints a log which commits() reads (S10), since a moment or of all references; paths are not quoted."""
    form = f"{COMMIT}%n%H%x09%P%x09%aI%x09%cI%x09%an%n%s%n{BODY}%n%b{END}"
    return ["git", "-C", repo, "-c", "core.quotepath=false", "log", "-M", "--raw", "--numstat", f"--pretty=format:{form}", *(["--all"] if every else []), *([f"--since={since}"] if since else [])]


def _entries(logs: DataFrame) -> DataFrame:
    """(log, place, head, body, tail): what stands between the marks of logs(log, text); entries without them are left out."""
    rows = logs.select("log", F.posexplode(F.split("text", COMMIT)).alias("place", "c"))
    b, e = F.locate(BODY, F.col("c")), F.locate(END, F.col("c"))
    head = F.filter(F.split(F.substr("c", F.lit(1), b - 1), "\n"), lambda x: x != "")
    body = F.substr(F.col("c"), b + len(BODY), F.greatest(e - b - len(BODY), F.lit(0)))
    out = rows.where((b > 0) & (e > 0)).select("log", "place", head.alias("head"), F.regexp_replace(F.regexp_replace(body, r"\A\n", ""), r"\s+\z", "").alias("body"), F.substr(F.col("c"), e + len(END)).alias("tail"))
    return out.where((F.size("head") >= 2) & (F.element_at(F.split(F.get("head", F.lit(0)), "\t"), 1) != ""))


def commits(logs: DataFrame) -> DataFrame:
    """(log, place, hash, parents, authored_at, committed_at, author, subject, body) of logs(log, text) as log_command() prints them."""
    field = lambda k: F.coalesce(F.get(F.split(F.get("head", F.lit(0)), "\t"), F.lit(k)), F.lit(""))
    names = ("authored_at", "committed_at", "author")
    return _entries(logs).select("log", "place", field(0).alias("hash"), F.filter(F.split(field(1), " "), lambda x: x != "").alias("parents"), *[field(k + 2).alias(n) for k, n in enumerate(names)], F.get("head", F.lit(1)).alias("subject"), "body")


def commit_files(logs: DataFrame) -> DataFrame:
    """(log, place, hash, path, status, old_path, additions, deletions, is_binary) of the same logs.

    A raw line gives a file's status and a rename's old path, a numstat line its counts (null for binary files); they meet by the final path.
    """
    hash_ = F.element_at(F.split(F.get("head", F.lit(0)), "\t"), 1)
    lines = _entries(logs).select("log", "place", hash_.alias("hash"), F.posexplode(F.split("tail", "\n")).alias("k", "line"))
    at = lambda k: F.nullif(F.get("_p", F.lit(k)), F.lit(""))
    raw = lines.where(F.startswith("line", F.lit(":"))).withColumn("_p", F.split(F.substr("line", F.lit(2)), "\t"))
    letter = F.substring(F.element_at(F.split(F.trim(F.get("_p", F.lit(0))), r"\s+"), -1), 1, 1)
    status = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
    moved = (letter == "R") & at(2).isNotNull()
    none = F.lit(None).cast("int")
    raw = raw.select("log", "place", "hash", "k", F.when(moved, at(2)).otherwise(at(1)).alias("path"), status.alias("status"), F.when(moved, at(1)).alias("old"), none.alias("additions"), none.alias("deletions"), F.lit(False).alias("is_binary"))
    stat = lines.where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t")).withColumn("_p", F.split("line", "\t"))
    old, new = renamed(F.get("_p", F.lit(2)))
    both = at(2).isNotNull() & at(3).isNotNull()
    binary = (at(0) == "-") | (at(1) == "-")
    count = lambda k: F.when(~binary, at(k).try_cast("int"))
    stat = stat.select("log", "place", "hash", "k", F.when(both, at(3)).otherwise(new).alias("path"), F.lit(None).cast("string").alias("status"), F.when(both, at(2)).when(old != new, old).alias("old"), count(0).alias("additions"), count(1).alias("deletions"), binary.alias("is_binary"))
    rows = raw.unionByName(stat).where("path <> ''")
    is_raw = F.col("status").isNotNull()
    last = lambda c, when: F.max_by(c, F.when(when, F.col("k")))
    out = rows.groupBy("log", "place", "hash", "path").agg(
        last("status", is_raw).alias("status"),
        F.coalesce(last("old", is_raw & F.col("old").isNotNull()), F.min_by("old", F.when(~is_raw & F.col("old").isNotNull(), F.col("k")))).alias("old_path"),
        *[last(c, ~is_raw).alias(c) for c in ("additions", "deletions", "is_binary")],
    )
    said = F.coalesce("status", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("modified"))
    return out.withColumns({"status": said, "is_binary": F.coalesce("is_binary", F.lit(False))})


def status_counts(lines: list[str]) -> dict[str, int]:
    """Staged, unstaged and untracked files of a porcelain status (S13); on the driver, as it is one working tree."""
    out = {"staged": 0, "unstaged": 0, "untracked": 0}
    for line in lines:
        if line.startswith("??"):
            out["untracked"] += 1
        elif len(line) > 2:
            out["staged"] += line[0] not in " ?"
            out["unstaged"] += line[1] not in " ?"
    return out


def commit_map(spark: SparkSession, path: str) -> DataFrame:
    """(old_hash, new_hash) of a commit map (S19): a hash of zeros is a pruned commit; an old hash twice is an error."""
    text = spark.read.text(path).where("value rlike '^[0-9a-f]{40} [0-9a-f]{40}$'")
    out = text.select(F.substring("value", 1, 40).alias("old_hash"), F.nullif(F.substring("value", 42, 40), F.lit("0" * 40)).alias("new_hash"))
    twice = out.groupBy("old_hash").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} is mapped twice")
    return out
