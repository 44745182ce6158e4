"""Clustering and hard negatives against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import clustering, hard_negatives
from emberlog.llm.clustering import cluster, loosening
from emberlog.llm.hard_negatives import score_bounds

NAN = float("nan")


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    if extra:
        for c in ("id", "v", "cluster", "upper", "lower", "distance", "place", "norm", "angles", "anchor", "slot", "score", "block"):
            df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def clustered(n, width, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [
        (i, (centres[i % 6] * (1 + i % 3) + rng.normal(size=width) * spread).astype(np.float32).tolist(), int(rng.integers(4)))
        for i in range(n)
    ]


def ints(vector):
    return [int(np.floor(256 * float(np.float32(x)))) for x in vector]


def plain_clusters(rows, k, rounds, width):
    import hashlib

    kept = [(i, ints(v)) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=repr), centroids


AWKWARD = [
    (None, [0.5, 0.5], 1), (1, None, 1), (2, [0.1], 1), (3, [0.1, None], 1), (4, [NAN, 0.0], 1), (5, [float("inf"), 0.0], 1),
    (6, [0.0, 0.0], 2), (6, [0.0, 0.0], 2), (7, [1.0, -1.0], None), (8, [], 0), (9, [-0.001, 0.001], 3), (700, [1.0, 2.0], 0), (700, [1.0, 2.0], 0),
]


@pytest.mark.parametrize("width,spread", [(2, 0.05), (8, 0.5)])
def test_clusters_like_plain_code(spark, width, spread):
    rows = clustered(400, width, spread=spread)
    found, centroids = cluster(vectors(spark, rows, extra=True), k=12, rounds=6, width=width)
    want, centres = plain_clusters(rows, 12, 6, width)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert centroids.tolist() == centres


def test_clusters_of_awkward_and_empty_tables(spark):
    for k in (1, 3, 40):
        found, centroids = cluster(vectors(spark, AWKWARD), k=k, rounds=3, width=2)
        want, centres = plain_clusters(AWKWARD, k, 3, 2)
        assert sorted(map(tuple, found.collect()), key=repr) == want
        assert centroids.tolist() == centres
    assert cluster(vectors(spark, AWKWARD).limit(0))[0].count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        cluster(vectors(spark, [(1, [1e30, 0.0], 0)]), width=2)


def test_loosening_is_right_and_less_than_the_drift():
    rng = np.random.default_rng(3)
    less = 0
    for _ in range(200):
        old = rng.integers(-300, 300, size=(4, 5))
        new = old + rng.integers(-60, 60, size=(4, 5))
        radius = rng.uniform(0, 250, size=4)
        found = loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(4):
            step = rng.normal(size=(300, 5))
            x = old[i] + step / np.sqrt((step**2).sum(axis=1))[:, None] * radius[i]
            others = [j for j in range(4) if j != i]
            nearer = max(
                (np.sqrt(((x - old[j]) ** 2).sum(axis=1)) - np.sqrt(((x - new[j]) ** 2).sum(axis=1))).max() for j in others
            )
            assert nearer <= found[i] + 1e-6
            assert found[i] <= drift[others].max() * (1 + 1e-6)
            less += found[i] < 0.9 * drift[others].max()
    assert less > 50


def plain_negatives(rows, is_anchor):
    kept = [
        (i, label, ints(v)) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in kept:
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in kept]
        same = sorted((s, j) for s, j, other in scored if other == label and j != i)[:5]
        for s, j in same:
            fits = sorted((t, n) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits[:10], 1)]
    return sorted(out)


def found_negatives(df):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 7 == 0).collect())


@pytest.mark.parametrize("width,spread", [(3, 0.05), (16, 0.6)])
def test_negatives_like_plain_code(spark, monkeypatch, width, spread):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    monkeypatch.setattr(hard_negatives, "RUN", 16)
    monkeypatch.setattr(hard_negatives, "_WAITING", 50)
    rows = clustered(300, width, seed=1, spread=spread)
    want = plain_negatives(rows, lambda i: i % 7 == 0)
    assert want and found_negatives(vectors(spark, rows, extra=True)) == want


def test_negatives_of_awkward_and_empty_tables(spark):
    rows = AWKWARD + [(i, [1.0, i / 50], i % 3) for i in range(10, 40)] + [(70, [2.0, 1.0, 3.0], 1)]
    assert found_negatives(vectors(spark, rows)) == plain_negatives(rows, lambda i: i % 7 == 0)
    assert found_negatives(vectors(spark, AWKWARD).limit(0)) == []
    assert found_negatives(vectors(spark, [(1, [1.0], 1)])) == []


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    v = np.array([ints(x) for _, x, _ in clustered(300, 6)])
    a, references = v[::29], v[:8]
    norm, norm_a = np.sqrt((v**2).sum(axis=1)), np.sqrt((a**2).sum(axis=1))
    angles = hard_negatives._angles(v, norm, references).astype(np.float32)
    angles_a = hard_negatives._angles(a, norm_a, references).astype(np.float32)
    score = v @ a.T
    lower, upper = score_bounds(angles, angles, norm, norm, angles_a, norm_a)
    assert (lower <= score).all() and (score <= upper).all()
    assert (upper < 0.5 * score.max()).mean() > 0.3
    some = rng.integers(0, len(v), 20)
    lower, upper = score_bounds(
        angles[some].min(axis=0)[None], angles[some].max(axis=0)[None], norm[some].min()[None], norm[some].max()[None], angles_a, norm_a
    )
    assert (lower <= score[some]).all() and (score[some] <= upper).all()
