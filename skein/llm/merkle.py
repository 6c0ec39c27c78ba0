"""Merkle manifest of a dataset: an external-memory store of nodes, and proofs by merge-scans.

Leaves are hashed where the rows are read and sorted, as short rows, into runs by source and doc_id; a leaf's
coordinate is its place among its source's leaves.  Nodes live in Parquet partitioned by level.  A pass reads one
stored level in order of coordinates, STEP levels at a time: a stripe of 3^STEP consecutive nodes is all that the
nodes above it need, so a task streams stripe after stripe, makes each level from the one before, and holds
one stripe.  Stripes are dealt by (source, number), so a source of any size spreads over all tasks.

Proofs go from the top down.  A scan merges a level's nodes, the inner nodes above them and what its stripes'
tops have for a proof, sorted by coordinate; a stripe's rows come together, so siblings are found by place and nothing
is looked up.  Each scan's result serves the stripes of the next lower one, at last the leaves.

The subroots, ordered by source, are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _shipped, scratch_dir, stored

#: Nodes that become one node of the next level.
RUN = 3
#: Levels that one pass makes; a task holds one stripe of RUN ** STEP nodes.
STEP = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "key string, level int, pos long, n long, hash binary"
_PATH = "array<struct<left: string, right: string>>"
_PROOF = f"key string, pos long, owner string, height int, doc_id long, hash binary, subroot binary, path {_PATH}, proof string, folded string"


def _sha(x: bytes) -> bytes:
    return hashlib.sha256(x).hexdigest().encode()


def leaf(**instead: Column) -> Column:
    """The digest of a row of documents as 32 bytes; columns may be replaced by name."""
    text = [instead.get(c, F.col(c)).cast("string") for c in FIELDS]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*told), 256))


@dataclass
class Forest:
    """Trees by key: leaves (key, pos, n, hash, owner, height, doc_id, altered), nodes by level, passes made."""

    leaves: DataFrame
    nodes: DataFrame
    passes: int

    def tops(self) -> DataFrame:
        """(key, height, hash): the one node that remains of each key."""
        alone = self.leaves.where("n = 1").select("key", F.lit(0).alias("height"), "hash")
        return alone.unionByName(self.nodes.where("n = 1").select("key", F.col("level").alias("height"), "hash"))


@dataclass
class Manifest:
    """The trees of the sources, the tree of their subroots, and the root's digest (None where there is no row)."""

    sources: Forest
    tree: Forest | None
    root: str | None

    def subroots(self) -> DataFrame:
        """(source, n_leaves, subroot)."""
        sizes = self.sources.leaves.where("pos = 0").select("key", "n")
        return self.sources.tops().join(sizes, "key").select(_source(), F.col("n").alias("n_leaves"), F.lower(F.hex("hash")).alias("subroot"))


def _source() -> Column:
    return F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source")


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows sorted by key and `by` into stored runs, with their place `pos` in their key and its count `n`.

    Places come from counts of (key, run): a few numbers for each run, never a window over a key's rows.
    """
    runs = stored(rows.repartitionByRange("key", *by).sortWithinPartitions("key", *by).withColumn("at", F.monotonically_increasing_id()))
    runs = runs.withColumn("run", F.shiftright("at", 33))
    counts = runs.groupBy("key", "run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    key = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(key.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("key", "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(key).alias("n")))
    return stored(runs.join(counts, ["key", "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("run", "at", "shift"))


def _above(hashes: list[bytes], n: int, step: int):
    """(n, hashes) of up to `step` levels over consecutive hex digests of a key that has n nodes there."""
    for _ in range(step):
        if n == 1:
            return
        hashes = [_sha(b"".join(hashes[i : i + RUN])) for i in range(0, len(hashes), RUN)]
        n = -(-n // RUN)
        yield n, hashes


def _grown(level: DataFrame, base: int, step: int) -> DataFrame:
    """Nodes of the next `step` levels over one level's (key, pos, n, hash), as far as a key has several nodes."""
    width = RUN**step

    def nodes(key, first, n, hashes):
        rows, start = [], first
        for k, (m, above) in enumerate(_above(hashes, n, step)):
            start //= RUN
            rows += [(key, base + k + 1, start + j, m, bytes.fromhex(h.decode())) for j, h in enumerate(above)]
        return rows

    def run(batches):
        held, of, out = [], None, []
        for b in batches:
            for key, pos, n, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = (key, pos // width)
                if at != of:
                    if of:
                        out += nodes(of[0], of[1] * width, count, held)
                    held, of, count = [], at, n
                held.append(h.hex().encode())
            if len(out) > 4096:
                yield _batch(out, _NODE)
                out = []
        if of:
            out += nodes(of[0], of[1] * width, count, held)
        if out:
            yield _batch(out, _NODE)

    stripe = F.expr(f"pos div {width}").alias("stripe")
    several = level.where("n > 1").select("key", "pos", "n", "hash", stripe)
    return several.repartition("key", "stripe").sortWithinPartitions("key", "pos").select("key", "pos", "n", "hash").mapInArrow(run, _NODE)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<left:": pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split()[:2] for x in schema.replace("left: string, right: string", "left:").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES[t.split(">")[0]]) for v, (_, t) in zip(zip(*rows, strict=True), named, strict=True)], [n for n, _ in named])


def _forest(rows: DataFrame, by: list[str], step: int) -> Forest:
    """Trees over rows(key, hash, owner, height, doc_id, altered and what orders them), by key in the order of `by`."""
    spark = rows.sparkSession
    leaves = _placed(rows, by)
    store, passes = scratch_dir(spark), 0
    level, largest = leaves, leaves.agg(F.max("n")).first()[0] or 0
    while True:
        _grown(level, passes * step, step).write.mode("append").partitionBy("level").parquet(store)
        passes += 1
        nodes = spark.read.schema("key string, pos long, n long, hash binary, level int").parquet(store)
        largest = -(-largest // RUN**step)
        if largest <= 1:
            return Forest(leaves, nodes, passes)
        level = nodes.where(F.col("level") == passes * step)


def _proved(forest: Forest, tops: DataFrame, step: int, digest: bool) -> DataFrame:
    """Proofs of a forest's leaves from those of its tops(key, height, path, subroot).

    digest: a leaf's own proof is folded (with `altered` in its place, if any) and only digests are returned.
    """
    last = F.greatest(F.floor((F.col("height") - 1) / F.lit(step)), F.lit(0)).cast("int")
    tops, upper = tops.select("key", F.lit(0).cast("long").alias("stripe"), "path", "subroot", last.alias("pass")), None
    for k in reversed(range(forest.passes)):
        base = k * step
        ends = tops.where(F.col("pass") == k).drop("pass")
        upper = ends if upper is None else upper.unionByName(ends)
        width = F.pow(F.lit(RUN), F.lit(base + step) - F.col("level")).cast("long")
        inner = forest.nodes.where((F.col("level") > base) & (F.col("level") < base + step) & (F.col("n") > 1))
        inner = inner.withColumn("width", width).select("key", F.expr("pos div width").alias("stripe"), (-F.col("level")).alias("turn"), "pos", "n", "hash")
        own = forest.leaves if k == 0 else forest.nodes.where((F.col("level") == base) & (F.col("n") > 1))
        rest = ["owner", "height", "doc_id", "altered"] if k == 0 else []
        own = own.select("key", F.expr(f"pos div {RUN**step}").alias("stripe"), F.lit(-base).alias("turn"), "pos", "n", "hash", *rest)
        rows = upper.withColumn("turn", F.lit(-(1 << 30))).unionByName(inner, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
        if k:
            rows = rows.select("*", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
        rows = rows.repartition("key", "stripe").sortWithinPartitions("key", "stripe", "turn", "pos")
        out = rows.select("key", "stripe", "turn", "pos", "n", "hash", "owner", "height", "doc_id", "altered", "path", "subroot").mapInArrow(_scan(base, step, digest and k == 0), _PROOF)
        if k == 0:
            return out
        upper = stored(out.select("key", F.col("pos").alias("stripe"), "path", "subroot"))


def _scan(base: int, step: int, digest: bool):
    """A task's merge-scan: rows sorted by (key, stripe, turn, pos), a stripe's top first and the nodes to prove last."""

    def proofs(key, upper, levels, own):
        """Rows of a stripe's nodes; levels: hex digests of the levels above them within the stripe."""
        path, subroot = upper
        over = [tuple((x["left"].encode(), x["right"].encode()) for x in path)]
        texts = [b"".join(a + b for a, b in over[0])]
        own_level, n = [r[1].hex().encode() for r in own], own[0][2]
        counts = [n]
        while counts[-1] > 1 and len(counts) < step:
            counts.append(-(-counts[-1] // RUN))
        chain = [own_level, *(levels[base + j] for j in range(1, len(counts)) if counts[j] > 1)]
        if n == 1:
            chain = []
        for nodes in reversed(chain):
            near = []
            for i in range(len(nodes)):
                a = i - i % RUN
                near.append((b"".join(nodes[a:i]), b"".join(nodes[i + 1 : a + RUN])))
            over = [(x, *over[i // RUN if len(over) > 1 else 0]) for i, x in enumerate(near)]
            texts = [x[0] + x[1] + texts[i // RUN if len(texts) > 1 else 0] for i, x in enumerate(near)]
        for i, (pos, h, _, owner, height, doc_id, altered) in enumerate(own):
            if digest:
                now = own_level[i] if altered is None else altered.hex().encode()
                for a, b in over[i]:
                    now = _sha(a + now + b)
                yield key, pos, owner, height, doc_id, h, subroot, None, _sha(texts[i]).decode(), now.decode()
            else:
                yield key, pos, owner, height, doc_id, h, subroot, [{"left": a.decode(), "right": b.decode()} for a, b in over[i]], None, None

    def run(batches):
        of, upper, levels, own, out = None, None, {}, [], []
        for b in batches:
            for key, stripe, turn, pos, n, h, owner, height, doc_id, altered, path, subroot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, stripe) != of:
                    if own:
                        out += proofs(of[0], upper, levels, own)
                    of, upper, levels, own = (key, stripe), None, {}, []
                if h is None:
                    upper = (path, subroot)
                elif turn == -base:
                    own.append((pos, h, n, owner, height, doc_id, altered))
                else:
                    levels.setdefault(-turn, []).append(h.hex().encode())
            while len(out) >= 1024:
                yield _batch(out[:1024], _PROOF)
                out = out[1024:]
        if own:
            out += proofs(of[0], upper, levels, own)
        for i in range(0, len(out), 1024):
            yield _batch(out[i : i + 1024], _PROOF)

    return run


def build(docs: DataFrame, altered: Column | None = None, step: int = STEP) -> Manifest:
    """The manifest of documents(doc_id, source, lang, n_chars, text).

    altered: a text to audit in place of each row's own; it does not change the manifest.  Null fields have their
    own mark, a null doc_id sorts first, a null source is a source of its own before all others; rows of one source and
    doc_id are ordered by digest, and repeated rows are leaves of their own; texts of any length are hashed whole; an
    empty table has no root; other columns are ignored.
    """
    _shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"), (F.lit(None) if altered is None else altered).cast("string").alias("other"))
    changed = F.when(F.lit(altered is not None) & ~F.col("other").eqNullSafe(F.col("text")), leaf(text=F.col("other")))
    key = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit(""))
    # the salt only parts repeated rows, so that any number of them can be cut into runs
    rows = docs.select(key.alias("key"), "doc_id", leaf().alias("hash"), changed.alias("altered"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("int").alias("height"), F.monotonically_increasing_id().alias("salt"))
    sources = _forest(stored(rows), ["doc_id", "hash", "salt"], step)
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered")]
    subroots = stored(sources.tops().select(F.lit("").alias("key"), F.col("key").alias("owner"), "height", "hash", *none))
    if subroots.isEmpty():
        return Manifest(sources, None, None)
    tree = _forest(subroots, ["owner"], step)
    return Manifest(sources, tree, tree.tops().first()["hash"].hex())


def _leaf_proofs(manifest: Manifest, step: int, digest: bool) -> DataFrame:
    empty = F.array().cast(_PATH)
    ends = manifest.tree.tops().select("key", "height", empty.alias("path"), "hash").withColumnRenamed("hash", "subroot")
    tops = stored(_proved(manifest.tree, ends, step, False).select(F.col("owner").alias("key"), "height", "path", F.col("hash").alias("subroot")))
    return _proved(manifest.sources, tops, step, digest)


def proofs(manifest: Manifest, step: int = STEP) -> DataFrame:
    """(doc_id, source, pos, leaf, subroot, path): path has the hex siblings left and right of each level up to the root."""
    if manifest.root is None:
        return manifest.sources.leaves.select("doc_id", _source(), "pos", F.lit("").alias("leaf"), F.lit("").alias("subroot"), F.array().cast(_PATH).alias("path"))
    out = _leaf_proofs(manifest, step, False)
    return out.select("doc_id", _source(), "pos", F.lower(F.hex("hash")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to, in hex."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def audit(docs: DataFrame, altered: Column, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the rows of documents, audited with altered texts.

    The first five describe the rows as they are; folded_root comes from the altered row and the original siblings.
    Cases are as in build().
    """
    manifest = build(docs, altered, step)
    if manifest.root is None:
        none = F.lit(None).cast("string")
        return manifest.sources.leaves.select("doc_id", *[none.alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    root = F.lit(manifest.root)
    out = _leaf_proofs(manifest, step, True)
    return out.select("doc_id", F.lower(F.hex("hash")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def without_newlines() -> Column:
    """The tampering of the audit: texts lose their newlines where 2 divides the CRC-32 of the decimal doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


_DIGEST = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS) + ")"
_TAMPERED = _DIGEST.replace("text::varchar", "other::varchar")
#: CRC-32, one bit of the decimal doc_id at a time.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"

SQL = f"""
with recursive d as (
  select doc_id, source, lang, n_chars, text, case when {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as other from documents
), base as (
  select doc_id, source, {_DIGEST} as leaf, {_TAMPERED} as changed from d
), placed as (
  select *, row_number() over (partition by source order by doc_id, leaf) - 1 as pos, count(*) over (partition by source) as n from base
), nodes as (
  select source, 0 as level, pos, n, leaf as hash from placed
  union all
  select source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' order by pos)) from nodes where n > 1 group by source, level, pos // 3, n
), subs as (
  select source, hash as subroot, level as height, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1
), top as (
  select 0 as level, pos, n, subroot as hash from subs
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' order by pos)) from top where n > 1 group by level, pos // 3, n
), beside as (
  select source, level, pos, n, coalesce(string_agg(hash, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(hash, '') over (w rows between 1 following and unbounded following), '') as r
  from nodes window w as (partition by source, level, pos // 3 order by pos)
), above as (
  select level, pos, n, coalesce(string_agg(hash, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(hash, '') over (w rows between 1 following and unbounded following), '') as r
  from top window w as (partition by level, pos // 3 order by pos)
), steps as (
  select p.source, p.pos, b.level as stage, b.l, b.r from placed p join beside b on b.source is not distinct from p.source and b.n > 1 and b.pos = p.pos // (3 ** b.level)::bigint
  union all
  select p.source, p.pos, s.height + a.level, a.l, a.r from placed p join subs s on s.source is not distinct from p.source join above a on a.n > 1 and a.pos = s.pos // (3 ** a.level)::bigint
), proof as (
  select source, pos, sha256(string_agg(l || r, '' order by stage)) as proof_sha256, max(stage) + 1 as steps from steps group by source, pos
), fold as (
  select source, pos, 0 as stage, changed as hash from placed
  union all
  select f.source, f.pos, f.stage + 1, sha256(s.l || f.hash || s.r) from fold f join steps s on s.source is not distinct from f.source and s.pos = f.pos and s.stage = f.stage
)
select p.doc_id, p.leaf, s.subroot, (select hash from top where n = 1) as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, f.hash as folded_root, f.hash = (select hash from top where n = 1) as verified
from placed p join subs s on s.source is not distinct from p.source left join proof q on q.source is not distinct from p.source and q.pos = p.pos
join fold f on f.source is not distinct from p.source and f.pos = p.pos and f.stage = coalesce(q.steps, 0)
"""
