"""Writes as new snapshots: splices, upserts, conflict rules and audit rows.  Plain Parquet has no MERGE, so each returns the next state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..storage import settled
from .relational import first_of, top_of
from .retrieval import most_similar

#: The vocabulary of a code graph.
CONFIDENCES = ("EXTRACTED", "INFERRED", "LIMITED")


def unknown_words(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Values outside a vocabulary with their counts (W3); a write goes ahead only if there are none."""
    return df.where(~F.col(column).isin(*vocabulary) | F.col(column).isNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def require_none(df: DataFrame, message: str) -> None:
    """Fail if there is any row."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0]}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The next state after inserting or updating rows by key (W7, W10, W11); columns in keep stay as first observed."""
    cols = old.columns
    o = old.select(*[F.col(c).alias(f"_o_{c}") if c not in keys else F.col(c) for c in cols], F.lit(True).alias("_old"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") if c not in keys else F.col(c) for c in cols], F.lit(True).alias("_new"))
    both = o.join(n, keys, "full")
    pick = lambda c: F.when(F.col("_new") & (F.lit(c not in keep) | F.col("_old").isNull()), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in cols])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of new whose key is not there yet, the first of each (W9, W28): what an idempotent append adds.

    order: columns that say which is first; without it the order of all other columns does, so a reread table gives the same rows.
    """
    return first_of(new, keys, order or [F.col(c) for c in new.columns if c not in keys] or [F.lit(1)]).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def upsert_guarded(old: DataFrame, new: DataFrame, keys: list[str], project: str = "project", keep: list[str] = ()) -> DataFrame:
    """An upsert (W11) that fails if a row of new would take over a key of another project."""
    theirs = old.select(*keys, F.col(project).alias("_p")).join(new.select(*keys, F.col(project).alias("_q")), keys).where(~F.col("_p").eqNullSafe(F.col("_q")))
    require_none(theirs, "a row of another project")
    return upsert(old, new, keys, keep)


def add_edges(old: DataFrame, new: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("from_kind", "from_id", "to_kind", "to_id", "relation")) -> DataFrame:
    """Links after an addition (G14): old and new have keys and a note; both ends must be known(kind, id), but for topics.

    A link that is there already keeps its note unless the new one has one.
    """
    for end in ("from", "to"):
        ends = new.where(F.col(f"{end}_kind") != "topic").select(F.col(f"{end}_kind").alias("kind"), F.col(f"{end}_id").alias("id"))
        require_none(ends.join(known, ["kind", "id"], "left_anti"), "an end that is not known")
    n = new.groupBy(*keys).agg(F.max("note").alias("_note"))
    both = old.select(*keys, "note").join(n, list(keys), "full")
    return both.select(*keys, F.coalesce("_note", "note").alias("note"))


def dedup_match(rows: DataFrame, incoming: DataFrame, model: str, least_cosine: float = 0.66, least_trigram: float = 0.5, alone_trigram: float = 0.8, most: int = 5) -> DataFrame:
    """(new_id, id, by): the row that each of incoming(new_id, rule, vector) repeats, if any.

    rows(id, rule, embedding, embedding_model) are active.  The `most` best by trigrams, from least_trigram on, are candidates.
    Those of the current model match by cosine only, and one that it rejects is not taken by trigrams; the best of another
    model matches by trigrams from alone_trigram on.  Without a vector the best of all does.
    """
    best = most_similar(incoming.select(F.col("new_id"), F.col("rule").alias("_rule")), rows.select("id", "rule"), least_trigram, most).withColumnRenamed("rank", "_n")
    c = best.join(rows.select("id", "embedding", F.col("embedding_model").eqNullSafe(model).alias("_current")), "id").join(incoming.select("new_id", "vector"), "new_id")
    c = c.withColumn("_cos", F.when(F.col("_current") & F.col("vector").isNotNull(), cosine(F.col("embedding"), F.col("vector"))))
    semantic = c.where(F.col("_cos") >= least_cosine).groupBy("new_id").agg(F.max_by("id", F.struct("_cos", -F.col("_n"))).alias("id")).withColumn("by", F.lit("cosine"))
    # of what cosine could not compare, only the best counts
    stale = c.where(F.col("vector").isNull() | ~F.col("_current")).groupBy("new_id").agg(F.min_by(F.struct("id", "score"), "_n").alias("_m"))
    lexical = stale.where(F.col("_m.score") >= alone_trigram).select("new_id", F.col("_m.id").alias("id"), F.lit("trigram").alias("by"))
    return semantic.unionByName(lexical.join(semantic.select("new_id"), "new_id", "left_anti"))


def splice(old: DataFrame, new: DataFrame, extractor: str, keys: list[str], shared: list[str] = ()) -> DataFrame:
    """Full replacement of one extractor's rows, but for shared kinds, which only gain."""
    stays = old.where((F.col("extracted_by") != extractor) | F.col("kind").isin(*shared)) if shared else old.where(F.col("extracted_by") != extractor)
    return upsert(stays, new, keys)


def splice_files(old: DataFrame, new: DataFrame, changed: DataFrame, deleted: DataFrame, keys: list[str], path: str = "file_path") -> DataFrame:
    """Incremental replacement (W2): rows of deleted files go, rows of changed files that are not in new go, the rest is upserted."""
    left = old.join(deleted.select(path), path, "left_anti")
    vanished = left.join(changed.select(path), path, "left_semi").join(new.select(*keys), keys, "left_anti").select(*keys)
    return upsert(left.join(vanished, keys, "left_anti").select(*old.columns), new, keys)


def filled_hashes(nodes: DataFrame) -> DataFrame:
    """Nodes without a content hash take that of their file's node (W5); two hashes for a file are an error."""
    files = nodes.where("kind = 'file' and content_hash is not null").groupBy("file_path").agg(F.count_distinct("content_hash").alias("n"), F.min("content_hash").alias("_hash"))
    require_none(files.where("n > 1"), "a file has more than one content hash")
    return nodes.join(files.select("file_path", "_hash"), "file_path", "left").withColumn("content_hash", F.coalesce("content_hash", "_hash")).drop("_hash").select(*nodes.columns)


def resolved(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Edges by name (from_kind, from_name, to_kind, to_name, relation) with node ids, and how many were dropped (W6): unresolved ends and loops."""
    n = nodes.select("kind", "qualified_name", "id")
    out = edges
    for end in ("from", "to"):
        out = out.join(n.select(F.col("kind").alias(f"{end}_kind"), F.col("qualified_name").alias(f"{end}_name"), F.col("id").alias(f"{end}_node")), [f"{end}_kind", f"{end}_name"])
    out = out.where("from_node <> to_node")
    return out, edges.count() - out.count()


def orphans(nodes: DataFrame, edges: DataFrame, shared: list[str]) -> DataFrame:
    """Shared nodes that nothing holds any more (W8): endpoints without a route served, others without any edge."""
    s = nodes.where(F.col("kind").isin(*shared))
    served = edges.where("relation = 'serves_route'").select(F.col("to_node").alias("id")).distinct()
    # once each: a node with many edges would bring all of them to one task
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("id")).distinct()
    return s.where("kind = 'endpoint'").join(served, "id", "left_anti").unionByName(s.where("kind <> 'endpoint'").join(ends, "id", "left_anti"))


def promoted(confidence: Column, given: float | None = None) -> Column:
    """Confidence of a promoted record."""
    return F.lit(float(given)) if given is not None else F.greatest(confidence, F.lit(0.85))


def reinforced(score: Column, times: Column | None = None) -> Column:
    """Score after one more confirmation, or so many."""
    return F.least(score + F.lit(0.05) * (F.lit(1) if times is None else times), F.lit(1.0))


def adjusted(score: Column, delta: Column) -> Column:
    """Score after a change, within its bounds."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + delta))


def audited(records: DataFrame, changes: DataFrame, order: list[str], project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, audit) after changes(id, delta, reason and what orders them) of the scores of records(id, project, score, ...).

    A record's changes are applied one after another, each clamped to 0 to 1, and each leaves a row (id, the order's columns, delta, reason, from,
    to, place) in the audit.  Changes of records that are not there, or of another project's, do nothing; those of no project are anyone's.
    A task passes through a record's changes in order and holds none of them.
    """
    own = records if project is None else records.where((F.col("project") == project) | F.col("project").isNull())
    rows = changes.select("id", *order, F.col("delta").cast("double").alias("delta"), "reason").join(own.select("id", F.col("score").cast("double").alias("_start")), "id")
    kinds = dict(rows.dtypes)
    names = ["id", *order, "delta", "reason"]

    def run(batches):
        of, score, place = None, 0.0, 0
        for b in batches:
            told = []
            for k, delta, start in zip(b.column(0).to_pylist(), b.column(names.index("delta")).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if place == 0 or k != of:
                    of, score, place = k, start, 0
                before, place = score, place + 1
                score = max(0.0, min(1.0, score + (delta or 0.0)))
                told.append((before, score, place))
            at = list(zip(*told, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(at[0], pa.float64()), pa.array(at[1], pa.float64()), pa.array(at[2], pa.int32())], [*names, "from", "to", "place"])

    sorted_ = rows.select(*names, "_start").repartition("id").sortWithinPartitions("id", *order)
    audit = settled(sorted_.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", `from` double, `to` double, place int"))
    last = audit.groupBy("id").agg(F.max_by("to", "place").alias("_now"))
    out = records.join(last, "id", "left").withColumn("score", F.coalesce("_now", F.col("score").cast("double"))).select(*records.columns)
    return out, audit


def confidence_label(score: Column) -> Column:
    """The label that a score is shown by."""
    return F.when(score < 0.35, "tentative").when(score < 0.75, "firm").otherwise("proven")


def bumped(df: DataFrame, ids: DataFrame, column: str, key: str = "id") -> DataFrame:
    """A counter raised by one for the named rows."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(1))
    return df.join(hit, key, "left").withColumn(column, F.col(column) + F.coalesce("_hit", F.lit(0))).drop("_hit")


def band_rank(df: DataFrame, band: list[str], column: str = "sort_order") -> DataFrame:
    """Places before the first and after the last of each band (W22), spaced by 1000."""
    return df.groupBy(*band).agg((F.min(column) - 1000.0).alias("before"), (F.max(column) + 1000.0).alias("after"))


def reordered(df: DataFrame, ids: list, key: str = "id", column: str = "sort_order") -> DataFrame:
    """Rows placed in a given order, 1000 apart (W23, N3); changed marks those that moved."""
    places = df.sparkSession.createDataFrame([(i, (k + 1) * 1000.0) for k, i in enumerate(ids)], [key, "_place"])
    out = df.join(places, key, "left").withColumn("_to", F.coalesce("_place", column))
    return out.withColumn("changed", ~F.col("_to").eqNullSafe(F.col(column))).withColumn(column, F.col("_to")).drop("_place", "_to")


def receipts(old: DataFrame, new: DataFrame, key: str = "receipt_key", digest: str = "sha256") -> DataFrame:
    """new with an outcome (W29): inserted, same, or conflict where the key holds another payload."""
    o = old.select(key, F.col(digest).alias("_had"))
    return new.join(o, key, "left").withColumn("outcome", F.when(F.col("_had").isNull(), "inserted").when(F.col("_had") == F.col(digest), "same").otherwise("conflict")).drop("_had")


def violations(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Writes that break the citation rule (§2.17): (id, violation).

    writes(id, session, citation, target, reason); reads(session, target).  A citation is needed; novel takes a reason of 50
    characters and some read; extends and supersedes name something that the session has read.
    """
    any_read = reads.select("session").distinct().withColumn("_any", F.lit(True))
    this = reads.select("session", "target").distinct().withColumn("_this", F.lit(True))
    w = writes.join(any_read, "session", "left").join(this, ["session", "target"], "left")
    kind = (
        F.when(F.col("citation").isNull(), "missing_citation")
        .when((F.col("citation") == "novel") & (F.length(F.coalesce("reason", F.lit(""))) < 50), "short_reason")
        .when((F.col("citation") == "novel") & F.col("_any").isNull(), "no_prior_read")
        .when(F.col("citation").isin("extends", "supersedes") & F.col("_this").isNull(), "unread_target")
    )
    return w.select("id", kind.alias("violation")).where("violation is not null")


def replaced_extracts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extracted records of sessions replaced (W27): un-retracted extracts go; descriptions that are still there are not added again."""
    gone = old.join(new.select("session").distinct(), "session", "left_semi").where("source = 'extracted' and retracted_at is null").select("id")
    left = old.join(gone, "id", "left_anti")
    added = new.dropDuplicates(["session", "description"]).join(left.select("session", "description"), ["session", "description"], "left_anti")
    return left.unionByName(added.select(*old.columns))


def restamped(nodes: DataFrame, head: str, ours: Column, column: str = "commit_sha") -> DataFrame:
    """Stamps raised to head for our rows, where they differ."""
    return nodes.withColumn(column, F.when(ours & ~F.col(column).eqNullSafe(head), head).otherwise(F.col(column)))
