"""Record keeping: citations and their effects, checklists, findings, ideas, cursors and traces."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import latest_holder, suffix_matches
from .relational import after
from .writes import reinforced


def superseded(rows: DataFrame, by: DataFrame, now: str) -> DataFrame:
    """Rows retired or replaced (W18): by(id, successor); no successor retires."""
    b = by.select("id", F.col("successor").alias("_s"), F.lit(True).alias("_hit"))
    out = rows.join(b, "id", "left")
    return out.withColumns({"superseded_by": F.coalesce("_s", "superseded_by"), "retired_at": F.when(F.col("_hit") & F.col("_s").isNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("retired_at"))}).drop("_s", "_hit")


def cited(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """Effects of citations(cited_id, relation, source) on rows(id, score, reinforcement_count, superseded).

    Extends reinforces once for each citation; supersedes applies where a person said so and is proposed else.
    """
    c = citations.groupBy(F.col("cited_id").alias("id")).agg(F.count_if(F.col("relation") == "extends").alias("_e"), F.bool_or((F.col("relation") == "supersedes") & (F.col("source") == "operator")).alias("_s"), F.bool_or((F.col("relation") == "supersedes") & (F.col("source") != "operator")).alias("_p"))
    out = rows.join(c, "id", "left").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in (("_e", 0), ("_s", False), ("_p", False))})
    score = F.when(F.col("_e") > 0, reinforced(F.col("score"), F.col("_e"))).otherwise(F.col("score"))
    return out.select("id", score.alias("score"), (F.col("reinforcement_count") + F.col("_e")).alias("reinforcement_count"), (F.col("superseded") | F.col("_s")).alias("superseded"), (F.col("_p") & ~F.col("_s")).alias("proposed"))


def checklist(docs: DataFrame, key: str = "slug", text: str = "text") -> DataFrame:
    """(key, place, done, task, task_hash) of markdown checklists."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("place", "line"))
    part = lambda n: F.regexp_extract("line", r"^\s*[-*] \[([ xX])\]\s+(.+?)\s*$", n)
    out = lines.withColumn("task", part(2)).where("task <> ''")
    return out.select(key, "place", (F.lower(part(1)) == "x").alias("done"), "task", F.sha2(F.lower("task"), 256).alias("task_hash"))


def synced_tasks(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """(key, task_hash, state): tasks after a sync (W30): new, open, done, or gone where the checklist has lost them."""
    o = old.select(key, "task_hash", F.lit(True).alias("_o"))
    n = new.groupBy(key, "task_hash").agg(F.bool_and("done").alias("_d"), F.lit(True).alias("_n"))
    both = o.join(n, [key, "task_hash"], "full")
    return both.select(key, "task_hash", F.when(F.col("_n").isNull(), "gone").when(F.col("_d"), "done").when(F.col("_o").isNull(), "new").otherwise("open").alias("state"))


def pending(tasks: DataFrame, key: str) -> DataFrame:
    """Open and all tasks by key."""
    return tasks.groupBy(key).agg(F.count_if(~F.col("done")).alias("open"), F.count(F.lit(1)).alias("total"))


def closed(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """findings(id, project, status) after changes(id, project, status, note) (Z16, Z17): outcome applied, needs_note, or foreign."""
    c = changes.select("id", F.col("project").alias("_p"), F.col("status").alias("_s"), F.col("note").alias("_n"))
    out = findings.join(c, "id", "left")
    outcome = F.when(F.col("_s").isNull(), F.lit(None)).when(F.col("_p") != F.col("project"), "foreign").when((F.col("_s") != "open") & (F.length(F.trim(F.coalesce("_n", F.lit("")))) == 0), "needs_note").otherwise("applied")
    return out.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "applied", F.col("_s")).otherwise(F.col("status"))).drop("_p", "_s", "_n")


def moved(ideas: DataFrame, moves: DataFrame) -> DataFrame:
    """Ideas after moves(id, band, by, evidence) (Z19): an agent needs evidence, an operator does not."""
    m = moves.where("by = 'operator' or length(trim(coalesce(evidence, ''))) > 0").groupBy("id").agg(F.max("band").alias("_b"))
    return ideas.join(m, "id", "left").withColumn("band", F.coalesce("_b", "band")).drop("_b")


def cursor(stream: str, values: list) -> str:
    """A page's cursor, bound to its stream."""
    tag = hashlib.sha256(stream.encode()).hexdigest()[:12]
    return base64.urlsafe_b64encode(json.dumps([tag, values]).encode()).decode()


def page_after(df: DataFrame, stream: str, columns: list[str], token: str | None, limit: int) -> tuple[DataFrame, list | None]:
    """The page after a cursor (L5), which is refused if it is another stream's or broken."""
    if token is None:
        return df.orderBy(*columns).limit(limit), None
    try:
        tag, values = json.loads(base64.urlsafe_b64decode(token))
    except (ValueError, TypeError) as e:
        raise ValueError("a broken cursor") from e
    if tag != hashlib.sha256(stream.encode()).hexdigest()[:12] or not isinstance(values, list) or len(values) != len(columns):
        raise ValueError("a cursor of another stream")
    return after(df, columns, values, limit), values


def trace(decisions: DataFrame, sessions: DataFrame, commits: DataFrame, files: DataFrame, nodes: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What became of decisions(id, project, at, paths) (G25): (decision, session), (decision, commit) and (decision, node).

    The session whose span holds the moment, commits of it that name the decision, and nodes whose path one of its paths ends, or ends.
    """
    s = latest_holder(decisions.select("id", "project", "at"), "id", "at", sessions, "session", F.col("started_at"), F.coalesce("ended_at", F.col("started_at") + F.make_dt_interval(hours=F.lit(6))), ["project"])
    named = commits.join(decisions.select("id", "project"), ["project", "id"], "left_semi").join(files.select("commit").distinct(), "commit", "left_semi")
    from .relational import top_of

    c = top_of(named, ["id"], [F.desc("committed_at"), F.col("commit")], most, "_n").select("id", "commit")
    paths = decisions.select("id", F.explode("paths").alias("path"))
    hit = suffix_matches(paths, "path", nodes.select(F.col("file_path")), "file_path")
    n = paths.join(hit, "path").join(nodes.select(F.col("id").alias("node"), "file_path"), "file_path").select("id", "node").distinct()
    return s, c, n


def lesson_page(attachments: DataFrame, node: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a node's active lessons."""
    return attachments.where((F.col("node") == node) & F.col("active")).orderBy("attached_at", "id").offset(offset).limit(limit)


def bounded_cue(text: str, count, most: int = 512) -> str:
    """The longest prefix of a text within so many tokens (Z7): a binary search over `count`, which must not fall as a text grows."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid - 1)
    return text[:low]


def hit_ratio(cached: Column, total: Column) -> Column:
    """Share of cached tokens; null without any."""
    return F.try_divide(cached, total)


def globalized(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that belong to all projects from now on."""
    hit = ids.select("id").distinct().withColumn("_g", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("project", F.when(F.col("_g").isNull(), F.col("project"))).drop("_g").select(*rows.columns)


def share_states(events: DataFrame) -> DataFrame:
    """(share_id, project, state, events) from requests(share_id, project, action, at) (W31): a request that changes nothing leaves no event."""
    w = Window.partitionBy("share_id", "project").orderBy("at")
    kept = events.withColumn("_b", F.lag("action").over(w)).where("_b is null or _b <> action")
    return kept.groupBy("share_id", "project").agg(F.max_by("action", "at").alias("state"), F.count(F.lit(1)).cast("int").alias("events"))


def posted_reviews(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(plan, review, pass, findings, recurring) of reviews(plan, review, at) that have findings(review, recurs)."""
    n = findings.groupBy("review").agg(F.count(F.lit(1)).alias("findings"), F.count_if("recurs").alias("recurring"))
    placed = reviews.withColumn("pass", F.row_number().over(Window.partitionBy("plan").orderBy("at", "review")))
    return placed.join(n, "review").select("plan", "review", "pass", "findings", "recurring")


def changed_facts(facts: DataFrame, added: DataFrame, promote: DataFrame, retract: DataFrame) -> DataFrame:
    """facts(id, project, retracted) after additions (once each), promotions to all projects and retractions."""
    rows = facts.unionByName(added.join(facts.select("id"), "id", "left_anti"))
    mark = lambda d, c: d.select("id").distinct().withColumn(c, F.lit(True))
    out = rows.join(mark(promote, "_p"), "id", "left").join(mark(retract, "_r"), "id", "left")
    return out.select("id", F.when(F.col("_p").isNull(), F.col("project")).alias("project"), (F.col("retracted") | F.coalesce("_r", F.lit(False))).alias("retracted"))
