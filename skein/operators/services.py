"""Composed reads: unified search, code search, coverage, shares and routing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_fraction
from ..functions.vectors import cosine, valid
from . import retrieval
from .graph import Step

#: Rows that a semantic code search looks at.
CENSUS = 20_000


def hash_embedder(size: int = 384):
    """A deterministic embedding of texts (R23): signed hashed words, normalised.  It stands in where no model is at hand."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for t in s:
                v = np.zeros(size)
                for w in (t or "")[:8000].lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1.0 if h >> 31 else -1.0
                n = np.sqrt((v * v).sum())
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return run


def reembedded(rows: DataFrame, model: str, embed, text: str = "text") -> DataFrame:
    """Rows whose vector is of another model get a new one (W13, Z2); the others keep theirs."""
    stale = ~F.col("embedding_model").eqNullSafe(model)
    done = rows.where(~stale)
    return done.unionByName(rows.where(stale).withColumn("embedding", embed(F.col(text))).withColumn("embedding_model", F.lit(model)))


def unified(sections: dict[str, DataFrame], limit: int) -> DataFrame:
    """One answer of several lanes (R25): (section, place, id, score, rank), each section cut by itself."""
    out = None
    for n, (name, rows) in enumerate(sections.items()):
        cut = rows.orderBy(F.desc("score"), "id").limit(limit).select(F.lit(name).alias("section"), F.lit(n).alias("place"), F.col("id").cast("string").alias("id"), "score")
        out = cut if out is None else out.unionByName(cut)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "id")))


def share_lane(rows: DataFrame, query: str, vector: list[float] | None, most: int = 3) -> DataFrame:
    """Shared records by cosine, or by the share of the query's tokens where there is no vector."""
    if vector is not None:
        return retrieval.by_vector(rows, vector, 0.25, most)
    return rows.withColumn("score", token_fraction(F.lit(query), F.col("text"))).where("score >= 0.34").orderBy(F.desc("score"), "id").limit(most)


def code_search(nodes: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 20) -> DataFrame:
    """Semantic code search (R22): (id, rank, score).

    nodes(id, identity, text), vectors(identity, body, cue): identities that occur twice are left out (Z3), the census is cut by
    identity, both vectors rank the same rows, the rankings are fused, and lexical hits fill what is missing (R19).
    """
    alone = nodes.join(nodes.groupBy("identity").count().where("count = 1").select("identity"), "identity", "left_semi")
    pool = alone.orderBy("identity").limit(CENSUS).join(vectors, "identity").where(valid(F.col("body")) & valid(F.col("cue")))
    q = retrieval.literal_vector(vector)
    scored = pool.select("id", cosine(F.col("body"), q).alias("b"), cosine(F.col("cue"), q).alias("c"))
    fused = retrieval.fuse(retrieval.ranked(scored, [F.desc("b"), F.col("id")]), retrieval.ranked(scored, [F.desc("c"), F.col("id")]))
    semantic = fused.select(F.lit("semantic").alias("lane"), "id", "score").orderBy(F.desc("score"), "id").limit(limit)
    lexical = retrieval.by_trigrams(nodes.join(pool.select("id"), "id", "left_anti"), query, 0.15, limit).select(F.lit("lexical").alias("lane"), "id", "score")
    return retrieval.merge_lanes(semantic, lexical, limit)


def coverage(nodes: DataFrame, vectors: DataFrame, model: str, capped: bool = False) -> DataFrame:
    """Vectors that are current, by document mode (Z1): (mode, eligible, current, complete)."""
    v = vectors.where(F.col("embedding_model") == model).select("identity", "fingerprint", F.lit(True).alias("_v"))
    out = nodes.join(v, ["identity", "fingerprint"], "left").groupBy("mode").agg(F.count(F.lit(1)).alias("eligible"), F.count("_v").alias("current"))
    return out.withColumn("complete", (F.col("eligible") == F.col("current")) & F.lit(not capped))


def identities(rows: DataFrame, *columns: str) -> DataFrame:
    """Stable identities and whether they are unique."""
    identity = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn("identity", identity).withColumn("is_unique", F.count(F.lit(1)).over(Window.partitionBy("identity")) == 1)


def recovered(jobs: DataFrame, now: str, seconds: int = 30) -> DataFrame:
    """Jobs whose heartbeat is too old (Z5): cancelled if that was asked for, else failed."""
    lost = (F.col("status") == "running") & (F.col("heartbeat_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.withColumn("status", F.when(lost, F.when(F.col("cancel_requested"), "cancelled").otherwise("failed")).otherwise(F.col("status")))


def routed(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule that fits (Z8): (pattern, route); nothing where the text quotes or negates."""
    out = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(r)) for p, r in rules])
    return F.when(~text.rlike(r"(?i)[\"“`]|\b(don't|do not|not|never)\b"), out)


def link_states(declared: DataFrame, granted: DataFrame) -> DataFrame:
    """Declared slugs against granted pairs (Z9): linked, declared or granted only."""
    d, g = declared.select("slug", F.lit(True).alias("_d")).distinct(), granted.select("slug", F.lit(True).alias("_g")).distinct()
    return d.join(g, "slug", "full").select("slug", F.when(F.col("_d") & F.col("_g"), "linked").when(F.col("_d"), "declared").otherwise("granted").alias("state"))


def live_states(shares: DataFrame, records: DataFrame) -> DataFrame:
    """What became of shared records (Z12): shares(id, record_id, project, content_hash), records(record_id, project, content, retracted_at)."""
    r = records.select("record_id", F.col("project").alias("_p"), F.sha2("content", 256).alias("_h"), F.col("retracted_at").alias("_r"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "deleted").when(F.col("_p") != F.col("project"), "moved").when(F.col("_r").isNotNull(), "retracted").when(F.col("_h") != F.col("content_hash"), "updated").otherwise("ok")
    return shares.join(r, "record_id", "left").select("id", state.alias("state"))


def of_either(df: DataFrame, a: str, b: str, value) -> DataFrame:
    """Rows that name a value at either end (G13, Z10): a union of two filters, each of which reaches the scan."""
    return df.where(F.col(a) == value).unionByName(df.where((F.col(b) == value) & ~F.col(a).eqNullSafe(F.lit(value))))


def freshness(scanned: Column, code_at: Column, configured: Column, url: Column) -> Column:
    """State of a scanned database schema."""
    return F.when(~configured, "not-configured").when(~url, "no-url").when(scanned.isNull(), "never").when(scanned < code_at, "behind-code").otherwise("fresh")


def plan_actions(plans: DataFrame, commits: DataFrame) -> DataFrame:
    """What commits after its approval say of a plan (T12): (slug, commits, action).

    plans(slug, path, token, approved_at, tasks_open), commits(commit_hash, message, files, committed_at): a commit counts by the plan's
    path among its files, or its slug or token as a word of the message.
    """
    words = commits.select("commit_hash", "committed_at", F.explode(F.array_distinct(F.concat(F.transform("files", lambda f: F.concat(F.lit("f:"), f)), F.transform(F.split(F.lower("message"), r"[^\w/-]+"), lambda w: F.concat(F.lit("w:"), w))))).alias("k"))
    keys = plans.select("slug", "approved_at", F.explode(F.array(F.concat(F.lit("f:"), "path"), F.concat(F.lit("w:"), F.lower("slug")), F.concat(F.lit("w:"), F.lower("token")))).alias("k"))
    hit = keys.join(words, "k").where("committed_at > approved_at").groupBy("slug").agg(F.count_distinct("commit_hash").alias("commits"))
    out = plans.join(hit, "slug", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    return out.select("slug", "commits", F.when(F.col("commits") == 0, "wait").when(F.col("tasks_open") == 0, "complete").otherwise("start").alias("action"))


@dataclass(frozen=True)
class GraphQuery:
    """A checked graph query."""

    seed: str
    by_id: bool
    steps: tuple[Step, ...]
    limit: int


def graph_query(raw: object) -> GraphQuery:
    """A query from plain JSON (P21): anything unknown, missing or of a wrong type is refused before any work."""
    if not isinstance(raw, dict) or set(raw) - {"seed", "steps", "limit"}:
        raise ValueError("a query has a seed, steps and a limit")
    seed = raw.get("seed")
    if not isinstance(seed, dict) or len(seed) != 1 or next(iter(seed)) not in ("node_id", "text") or not isinstance(value := next(iter(seed.values())), str) or not value.strip():
        raise ValueError("a seed is one node_id or text")
    steps = raw.get("steps")
    if not isinstance(steps, list) or not 1 <= len(steps) <= 3:
        raise ValueError("one to three steps")
    out = []
    for s in steps:
        if not isinstance(s, dict) or set(s) - {"direction", "relations", "target_kinds"} or s.get("direction") not in ("in", "out", "both"):
            raise ValueError("a step has a direction, relations and target_kinds")
        lists = [s.get("relations"), s.get("target_kinds", [])]
        if any(not isinstance(x, list) or any(not isinstance(y, str) for y in x) for x in lists) or not lists[0]:
            raise ValueError("relations and target_kinds are lists of names")
        out.append(Step(s["direction"], tuple(lists[0]), tuple(lists[1])))
    limit = raw.get("limit", 20)
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
        raise ValueError("a limit from 1 to 100")
    return GraphQuery(value, "node_id" in seed, tuple(out), limit)
