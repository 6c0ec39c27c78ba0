"""Ball k-means in exact integers.

A cluster is a ball: a centroid and a radius that no member lies beyond.  If x is a member of ball i, a centroid j can only
be nearer (or as near) where d(c_i, c_j) <= 2 d(x, c_i), so

* ball j is a neighbour of ball i only if d(c_i, c_j) <= 2 r_i;
* members within half the distance to the nearest neighbour form the stable core and stay;
* the others lie in annuli between the halved distances to the neighbours in turn: those in annulus l are compared
  with the l nearest neighbours and with no other centroid.

All distances are squared and integer, so the tests are exact: 4 D(x, c_i) >= D(c_i, c_j).

The tests hold for whatever ball a vector is taken to be a member of, which is the one it is stored under.  So a round
reads the stored vectors once, writes nothing and shuffles sums of k balls only; when more than a given share of the vectors has
left the balls they are stored under, they are stored anew under their present ones.  Radii come with the sums; when
a centroid has moved by s, a radius r becomes r + s at most, until it is measured again.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _shipped, dropped, stored

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
#: The share of vectors outside the balls they are stored under from which on they are stored anew.
MOVED = 0.1
#: Components beyond +-2^26 would not leave four times a squared distance within 64 bits.
MOST = 1 << 26


@dataclass
class Balls:
    """Integer centroids, the radius bounds of stored balls (squared, None: unknown), and each ball's neighbours."""

    centroids: list[list[int]]
    reach: list[int | None]

    def neighbours(self) -> list[tuple[list[int], list[int]]]:
        """Of each ball: neighbour numbers and squared distances, nearest first."""
        out = []
        for i, c in enumerate(self.centroids):
            far = sorted((sum((a - b) ** 2 for a, b in zip(c, o, strict=True)), j) for j, o in enumerate(self.centroids) if j != i)
            near = [(d, j) for d, j in far if self.reach[i] is None or d <= 4 * self.reach[i]]
            out.append(([j for _, j in near], [d for d, _ in near]))
        return out


def _root_up(x: int) -> int:
    """The square root of an integer, rounded up."""
    return math.isqrt(x - 1) + 1 if x > 0 else 0


def assigned(x: np.ndarray, ball: np.ndarray, centroids: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, squared distance to the stored ball, exact comparisons) of int64 rows x stored under `ball`."""
    to = lambda rows, j: np.einsum("ij,ij->i", rows - centroids[j], rows - centroids[j])
    best, least, own, compared = ball.copy(), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), len(x)
    for i in np.unique(ball):
        members = np.flatnonzero(ball == i)
        d = to(x[members], i)
        order = np.argsort(d, kind="stable")
        members, d = members[order], d[order]
        own[members] = d
        numbers, nearest = np.full(len(d), i), d.copy()
        others, gaps = near[i]
        # members by distance: those from `start` on reach into the annulus of this neighbour and the ones before it
        for j, start in zip(others, np.searchsorted(4 * d, np.array(gaps, np.int64)), strict=True):
            if start == len(d):
                break
            e = to(x[members[start:]], j)
            compared += len(e)
            nearer = (e < nearest[start:]) | ((e == nearest[start:]) & (j < numbers[start:]))
            numbers[start:][nearer], nearest[start:][nearer] = j, e[nearer]
        best[members], least[members] = numbers, nearest
    return best, least, own, compared


def quantized(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly `width` components, none null or non-finite, as floor(scale * component)."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where((F.size(x) == width) & fine)
    each = lambda v: F.when(F.abs(v * scale) <= MOST, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is beyond 2^26")).cast("int"))
    return rows.select("vec_id", F.transform("embedding", each).alias("x"))


def _pass(table: DataFrame, balls: Balls, result: str):
    """Each batch of (vec_id, ball, x) under the given balls.

    sums: (kind, ball, place, value), partial sums per ball, the reach of stored balls and the radius of present ones; rows: (vec_id, cluster, distance); stored: (vec_id, ball, x).
    """
    centroids, near = np.array(balls.centroids, np.int64), balls.neighbours()
    k, width = centroids.shape
    schema = {"sums": "kind string, ball int, place int, value long", "rows": "vec_id long, cluster int, distance long", "stored": "vec_id long, ball int, x array<int>"}[result]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy().astype(np.int64).reshape(-1, width)
            ball = b.column(1).to_numpy().astype(np.int64)
            best, least, own, compared = assigned(x, ball, centroids, near)
            if result == "rows":
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(least)], ["vec_id", "cluster", "distance"])
            elif result == "stored":
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), b.column(2)], ["vec_id", "ball", "x"])
            else:
                counts = np.bincount(best, minlength=k)
                found = [("compared", 0, 0, compared), ("left", 0, 0, int((best != ball).sum()))]
                for j in range(k):
                    if counts[j]:
                        found.append(("count", j, 0, int(counts[j])))
                        found.append(("radius", j, 0, int(least[best == j].max())))
                        found += [("sum", j, p, v) for p, v in enumerate(x[best == j].sum(axis=0).tolist())]
                    if (mine := ball == j).any():
                        found.append(("reach", j, 0, int(own[mine].max())))
                kinds, numbers, places, values = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), pa.array(values, pa.int64())], ["kind", "ball", "place", "value"])

    return table.select("vec_id", "ball", "x").mapInArrow(run, schema)


def _summed(table: DataFrame, balls: Balls) -> dict:
    """Sums over all vectors, at most k * (width + 3) + 2 numbers; exact beyond 64 bits."""
    parts = _pass(table, balls, "sums").groupBy("kind", "ball", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.max("value").alias("most"))
    return {(r["kind"], r["ball"], r["place"]): r["most"] if r["kind"] in ("reach", "radius") else int(r["total"]) for r in parts.collect()}


@dataclass
class Clusters:
    """rows (vec_id, cluster, distance), the final centroids, and per round what share of all comparisons was made."""

    rows: DataFrame
    centroids: list[list[int]]
    compared: list[float]


def starts(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:vec_id`, in ascending order of it; rows without a vec_id start nothing."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in vectors.select(name.alias("name"), "x").where("name is not null").orderBy("name", "x").limit(clusters).collect()]


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clusters | None:
    """Clusters of (vec_id, x): `rounds` rounds of assignment and floored means, then one more assignment; None without a start."""
    _shipped(vectors.sparkSession)
    table = stored(vectors.select("vec_id", F.lit(0).alias("ball"), "x"))
    first = starts(table, clusters, seed)
    if not first:
        return None
    balls, compared = Balls(first, [None] * len(first)), []
    for _ in range(rounds):
        found = _summed(table, balls)
        n = sum(v for (kind, _, _), v in found.items() if kind == "count")
        compared.append(found["compared", 0, 0] / (n * len(first)))
        width = len(first[0])
        means = [[found["sum", j, p] // found["count", j, 0] for p in range(width)] if ("count", j, 0) in found else c for j, c in enumerate(balls.centroids)]
        if found["left", 0, 0] > MOVED * n:
            new = stored(_pass(table, balls, "stored"))
            dropped(table)
            table, kind = new, "radius"
        else:
            kind = "reach"
        reach = [found.get((kind, j, 0), 0) for j in range(len(first))]
        moved = [sum((a - b) ** 2 for a, b in zip(c, o, strict=True)) for c, o in zip(balls.centroids, means, strict=True)]
        balls = Balls(means, [None if r is None else (_root_up(r) + _root_up(s)) ** 2 for r, s in zip(reach, moved, strict=True)])
    return Clusters(stored(_pass(table, balls, "rows")), balls.centroids, compared)


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of embeddings(vec_id, embedding).

    Vectors of another width, or with null or non-finite components, or null, give no row.  A vector without a vec_id
    belongs to a cluster like others but starts none; repeated rows count as different vectors, and those
    of one vec_id start clusters in the order of their components.  Fewer vectors than clusters make fewer clusters; without vectors there are no rows.  A
    component of more than 2^26 after scaling is an error, as distances would leave 64 bits.  Other columns are ignored.
    """
    found = fit(quantized(embeddings, width, scale), clusters, rounds, seed)
    if found is None:
        none = embeddings.limit(0)
        return none.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    sums = {r["cluster"]: r["total"] for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertias = [int(sums.get(j, 0)) for j in range(len(names))]
    return found.rows.select("vec_id", "cluster", "distance", of(inertias).cast("long").alias("cluster_inertia"), F.lit(sum(inertias)).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))
