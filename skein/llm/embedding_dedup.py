"""Embedding near-duplicates by an epsilon grid order join.

cosine >= c means that the unit vectors lie within eps = sqrt(2 - 2c).  Equal vectors of a label are collapsed
first.  Unit vectors are projected on their leading principal dimensions, gridded with cells of eps, sorted by
label and cells, and cut into blocks with bounding boxes.  Blocks of a label meet only if their boxes are within
eps; each meeting recursively halves the two sequence intervals, skips halves that are provably distant, and
compares the leaves exactly in double precision.  A meeting returns link counts per vector and a spanning forest of
its links, so neither pairs nor vectors are gathered.

Neighbouring blocks of a label travel together as a group: a group's vectors are sent once for each group that it meets,
with the list of their meeting blocks.  Vectors find their class by a digest, so only groups carry vectors.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .simhash import Forest

COSINE = 0.98
LEADING = 8
BLOCK, LEAF = 512, 64
#: Blocks of a group, and the bytes of vectors that it holds at most (but one block at least).
GROUP, GROUP_BYTES = 16, 16 << 20
_SLACK = 1e-9
#: Cosines this close to the bound are computed exactly.
BORDER = 1e-12


def usable() -> F.Column:
    """Vectors that can link: no null or non-finite component, not all zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _axes(classes: DataFrame, dim: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes of all unit vectors; partial moments are summed by Spark."""

    def run(batches):
        n, total, outer = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            u = _units(_matrix(b.column(0)))
            n, total, outer = n + len(u), total + u.sum(axis=0), outer + u.T @ u
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim + dim + 1)), pa.array(np.concatenate((outer.ravel(), total, [n])))], ["k", "v"])

    rows = classes.select("embedding").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros(dim * dim + dim + 1)
    m[rows["k"].to_numpy(np.int64)] = rows["v"].to_numpy()
    n, mean = max(m[-1], 1), m[dim * dim : -1] / max(m[-1], 1)
    _, vectors = np.linalg.eigh(m[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(vectors[:, ::-1][:, : min(leading, dim)])


def _groups(classes: DataFrame, dim: int, eps: float, leading: int) -> DataFrame:
    """(group, label, boxes, units, places, reps, copies): up to GROUP blocks in grid order with a box each."""
    mean, axes = _axes(classes, dim, leading)
    size = BLOCK * max(1, min(GROUP, GROUP_BYTES // (BLOCK * (dim + leading) * 8)))

    def project(batches):
        for b in batches:
            u = _units(_matrix(b.column(1)))
            cells = np.floor((u - mean) @ axes / eps).astype(np.int64) + (1 << 20)
            keys = ["".join(f"{c:06x}" for c in row) for row in cells.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), b.column(1), b.column(2), b.column(3)], ["label", "cells", "embedding", "rep", "copies"])

    def pack(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * size:
                yield from cut(held)
                held = []
        if held:
            yield from cut(held)

    def cut(held):
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        label = t.column("label").to_numpy()
        u = _units(_matrix(t.column("embedding").chunk(0)))
        p = (u - mean) @ axes
        reps, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        rows = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            for i in range(a, z, size):
                j = min(i + size, z)
                boxes = []
                for x in range(i, j, BLOCK):
                    low, high = p[x : min(x + BLOCK, j)].min(axis=0), p[x : min(x + BLOCK, j)].max(axis=0)
                    boxes.append({"first": int(np.floor(low[0] / eps)), "last": int(np.floor(high[0] / eps)), "low": low.tolist(), "high": high.tolist()})
                rows.append((uuid.uuid4().hex, int(label[a]), boxes, u[i:j].tobytes(), p[i:j].tobytes(), reps[i:j].tobytes(), copies[i:j].tobytes()))
        box = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        types = (pa.string(), pa.int64(), pa.list_(box), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["group", "label", "boxes", "units", "places", "reps", "copies"]
        yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], y) for x, y in enumerate(types)], names)

    placed = classes.select("label", "embedding", "rep", "copies").mapInArrow(project, "label long, cells string, embedding array<double>, rep long, copies long")
    spark = classes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        placed.repartitionByRange(n, "label", "cells")
        .sortWithinPartitions("label", "cells")
        .select("label", "embedding", "rep", "copies")
        .mapInArrow(pack, "group string, label long, boxes array<struct<first: long, last: long, low: array<double>, high: array<double>>>, units binary, places binary, reps binary, copies binary")
    )


def ego_join(u: np.ndarray, p: np.ndarray, v: np.ndarray, q: np.ndarray, same: bool, cosine: float, eps: float):
    """Index pairs (i, j) of two sequences of unit vectors u, v at places p, q whose cosine reaches the bound, in batches."""
    stack = [(0, len(u), 0, len(v))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c + d < a + b and (a, b) != (c, d):  # the mirror image is on the stack
            continue
        gap = np.maximum(0, np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            dots = u[a:b] @ v[c:d].T
            i, j = np.nonzero(dots >= cosine - BORDER)
            # a product's last bits depend on the shape of the blocks: near the bound they are taken anew, in one order
            near = np.flatnonzero(dots[i, j] < cosine + BORDER)
            if len(near):
                exact = np.array([math.fsum(x) for x in u[a + i[near]] * v[c + j[near]]])
                i, j = np.delete(i, near[exact < cosine]), np.delete(j, near[exact < cosine])
            if same and (a, b) == (c, d):
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i + a, j + c
            continue
        m, k = (a + b + 1) // 2, (c + d + 1) // 2
        left = [(a, m), (m, b)] if b - a > 1 else [(a, b)]
        right = [(c, k), (k, d)] if d - c > 1 else [(c, d)]
        stack += [(*x, *y) for x in left for y in right]


def _meet(row: dict, same: bool, cosine: float, eps: float):
    """Link counts and spanning links of the meeting blocks of a pair of groups."""
    load = lambda n, t: np.frombuffer(row[n], t)
    ra, rb, ca, cb = load("reps_a", np.int64), load("reps_b", np.int64), load("copies_a", np.int64), load("copies_b", np.int64)
    u, v = load("units_a", np.float64).reshape(len(ra), -1), load("units_b", np.float64).reshape(len(rb), -1)
    p, q = load("places_a", np.float64).reshape(len(ra), -1), load("places_b", np.float64).reshape(len(rb), -1)
    na = np.zeros(len(ra), np.int64)
    nb = na if same else np.zeros(len(rb), np.int64)
    shift = 0 if same else len(ra)
    forest = Forest(len(ra) + (0 if same else len(rb)))
    for code in row["blocks"]:
        x, y = divmod(code, GROUP)
        a, b = slice(x * BLOCK, (x + 1) * BLOCK), slice(y * BLOCK, (y + 1) * BLOCK)
        for i, j in ego_join(u[a], p[a], v[b], q[b], same and x == y, cosine, eps):
            i, j = i + a.start, j + b.start
            np.add.at(na, i, cb[j])
            np.add.at(nb, j, ca[i])
            forest.add(i, j + shift)
    ids = ra if same else np.concatenate((ra, rb))
    e = np.array(forest.links, np.int64).reshape(-1, 2)
    counts = [(ra, na)] if same else [(ra, na), (rb, nb)]
    a = np.concatenate([x[y > 0] for x, y in counts] + [ids[e[:, 0]]])
    b = np.concatenate([y[y > 0] for _, y in counts] + [ids[e[:, 1]]])
    edge = np.zeros(len(a), bool)
    edge[len(a) - len(e) :] = True
    return a, b, edge


def _links(classes: DataFrame, dim: int, cosine: float, leading: int) -> DataFrame:
    """(a, b, edge): a link of classes a and b, or (edge false) b links counted at class a."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    groups = stored(_groups(classes, dim, eps, leading))
    boxes = groups.select("label", "group", F.posexplode("boxes").alias("k", "box")).select("label", "group", "k", "box.*")
    side = lambda s, far: boxes.select("label", F.explode(F.sequence(F.col("first") - far, F.col("last") + far)).alias("cell"), *[F.col(c).alias(f"{c}_{s}") for c in ("group", "k", "low", "high")])
    gap = F.aggregate(
        F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)),
        F.lit(0.0),
        lambda acc, x: acc + x * x,
    )
    once = F.struct("group_a", "k_a") <= F.struct("group_b", "k_b")
    code = (F.col("k_a") * GROUP + F.col("k_b")).alias("code")
    # both orders of a pair can come through different cells; the first dimension's cells are symmetric up to one
    near = [side("a", x).join(side("b", 1 - x), ["label", "cell"]).where(once).where(gap <= eps * eps).select("group_a", "group_b", code) for x in (1, 0)]
    # at most GROUP x GROUP pairs of blocks in a list
    pairs = stored(near[0].unionByName(near[1]).groupBy("group_a", "group_b").agg(F.collect_set("code").alias("blocks")))
    half = lambda s: groups.select(*[F.col(c).alias(f"{c}_{s}") for c in ("group", "units", "places", "reps", "copies")])
    meetings = pairs.join(half("a"), "group_a").join(half("b"), "group_b")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b, edge = _meet(row, row["group_a"] == row["group_b"], cosine, eps)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(edge)], ["a", "b", "edge"])

    spark, key = classes.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    # a row holds two groups: as many as fit in 64 MB
    spark.conf.set(key, str(max(1, min(16, (64 << 20) // (2 * max(BLOCK * (dim + leading) * 8, min(GROUP * BLOCK * (dim + leading) * 8, GROUP_BYTES)))))))
    try:
        return stored(meetings.mapInArrow(run, "a long, b long, edge boolean"))
    finally:
        spark.conf.set(key, before)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, leading: int = LEADING) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of embeddings(vec_id, embedding, label).

    Vectors link within a label (not null) at a cosine of at least `cosine`, in double precision, and only with
    vectors of as many components.  n_links: other vectors linked directly, copies included; component_id: smallest
    vec_id reachable, itself included.  Null, empty, zero or non-finite vectors and null labels link with nothing.
    Repeated rows count as different vectors; an empty table gives no rows; other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    # equal vectors have equal digests, and different ones different digests
    digest = F.unhex(F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256))
    rows = rows.withColumn("digest", F.when(usable(), digest))
    classes = stored(rows.where("digest is not null").groupBy("label", "digest", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("rep is not null"))
    found = None
    for (dim,) in classes.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect():  # vector widths: a handful
        part = _links(classes.where(F.size("embedding") == dim), dim, cosine, leading)
        found = part if found is None else found.unionByName(part)
    out = classes.select("label", "digest", "rep", (F.col("copies") - 1).alias("own"))
    if found is not None:
        near = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("near"))
        joined = components(found.where("edge")).select(F.col("node").alias("rep"), "component")
        out = out.join(near, "rep", "left").join(joined, "rep", "left").select("label", "digest", (F.col("own") + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    else:
        out = out.select("label", "digest", F.col("own").alias("n_links"), F.col("rep").alias("component_id"))
    out = stored(out)
    return rows.select("vec_id", "label", "digest").join(out, ["label", "digest"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept")
    )
