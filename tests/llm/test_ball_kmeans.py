import hashlib
import math
import random

import numpy as np
import pytest

from skein.llm import ball_kmeans as op


def brute(rows, clusters, rounds, width, scale=1024, seed=3):
    """Every vector against every centroid in every round, in Python's integers."""
    kept = []
    for k, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((k, [math.floor(scale * x) for x in v]))
    named = sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), x) for k, x in kept if k is not None)
    centroids = [x for _, x in named[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    at = lambda: [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
    if not centroids:
        return []
    for _ in range(rounds):
        of = at()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, c) in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    of = at()
    inertia = [sum(d for d, c in of if c == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((k, c, d, inertia[c], sum(inertia), names[c]) for (k, _), (d, c) in zip(kept, of, strict=True)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, ball int, distance string")


def found(spark, rows, **how):
    got = op.cluster(table(spark, rows), **how)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def near(rng, n, width, centres, spread):
    c = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(centres)]
    return [(k, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(c)]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_against_all_distances(spark, spread):
    rng = random.Random(int(spread * 100))
    rows = near(rng, 400, 64, 6, spread)
    assert found(spark, rows) == brute(rows, 8, 10, 64)


def test_ties_go_to_the_smaller_number(spark):
    rng = random.Random(8)
    rows = [(k, [float(rng.randrange(-2, 3)), float(rng.randrange(-2, 3))]) for k in range(300)]
    for clusters in (2, 7):
        assert found(spark, rows, clusters=clusters, rounds=4, width=2, scale=1) == brute(rows, clusters, 4, 2, 1)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = near(rng, 40, 4, 3, 0.3)
    rows += [rows[0], rows[0], (7, rows[3][1]), (None, rows[5][1]), (None, None), (90, None), (91, []), (92, [1.0] * 3), (93, [1.0] * 5), (94, [1.0, None, 1.0, 1.0]), (95, [math.nan] * 4), (96, [math.inf, 0.0, 0.0, 0.0]), (97, [0.0] * 4), (98, [-0.0] * 4)]
    assert found(spark, rows, width=4) == brute(rows, 8, 10, 4)


def test_few_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (3, None)]
    assert found(spark, rows) == brute(rows, 8, 10, 64) and len(found(spark, rows)) == 2
    assert found(spark, []) == [] and found(spark, [(None, [0.5] * 64), (4, [0.5])]) == []


def test_comparisons_are_spared(spark):
    rng = random.Random(1)
    vectors = op.quantized(table(spark, near(rng, 600, 64, 8, 0.02)))
    compared = op.fit(vectors).compared
    assert compared[0] <= 1 and compared[-1] < 0.6  # some balls share a centre of the data


def test_assignment_holds_for_any_stored_ball():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-50, 50, (9, 3))
    x = rng.integers(-60, 60, (500, 3))
    d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    for _ in range(5):
        ball = rng.integers(0, 9, 500)
        reach = [int(max([0, *d[ball == j, j]])) for j in range(9)]
        best, least, own, compared = op.assigned(x, ball, centroids, op.Balls(centroids.tolist(), reach).neighbours())
        assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all() and (own == d[np.arange(500), ball]).all()
        assert compared < 500 * 9


def test_too_far(spark):
    with pytest.raises(Exception, match="2\\^26"):
        op.cluster(table(spark, [(1, [1e30] * 64)])).count()
