"""Nearest pairs, k-means, silhouettes and mean distances against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.operators import similar


def frame(spark, points, parts=4):
    return spark.createDataFrame([(f"e{i:06d}", [float(x) for x in p]) for i, p in enumerate(points)], "entity string, v array<double>").repartition(parts)


def clouds():
    rng = np.random.default_rng(3)
    return {
        "cloud": rng.normal(size=(300, 3)),
        "copies": np.repeat(rng.normal(size=(4, 2)), [40, 3, 1, 30], axis=0),
        "few copies": np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(1, 2)).repeat(3, 0)]),
        "lattice": np.array([(x, y) for x in range(12) for y in range(12)], float),
        "line": np.array([(x * x,) for x in range(50)], float),
        "three": np.array([(0, 0), (1, 0), (5, 5)], float),
        "one": np.array([(1, 1)], float),
    }


def all_pairs(points, kind):
    diff = np.abs(points[:, None, :] - points[None, :, :])
    d = diff.sum(axis=2) if kind == "manhattan" else np.sqrt((diff**2).sum(axis=2))
    pairs = [(d[i, j], f"e{i:06d}", f"e{j:06d}") for i in range(len(points)) for j in range(i + 1, len(points))]
    return sorted(pairs), d.max(initial=0.0)


@pytest.mark.parametrize(("name", "kind"), [("cloud", "manhattan"), *((n, "euclidean") for n in clouds())])
def test_top_pairs(spark, name, kind):
    points = clouds()[name]
    pairs, most = all_pairs(points, kind)
    got = similar.similarity(frame(spark, points), kind, 12, block=16).collect()
    want = [(a, b, pytest.approx(d, abs=1e-9), pytest.approx(1 - d / most if most else 1.0, abs=1e-9)) for d, a, b in pairs[:12]]
    if name == "lattice":  # many equal distances, which square roots keep equal
        assert [(r["left"], r["right"]) for r in got] == [(a, b) for _, a, b in sorted((round(d, 9), a, b) for d, a, b in pairs)[:12]]
    assert [tuple(r) for r in got] == want


def test_top_pairs_of_many(spark):
    """50,000 entities, of which 12 pairs lie closer than all others: no pair in a thousand is formed."""
    d = spark.range(0, 50_000, 1, 8).select("id", (F.col("id") % 50).cast("double").alias("x"), (F.floor(F.col("id") / 50) % 40).cast("double").alias("y"), F.floor(F.col("id") / 2000).cast("double").alias("z"))
    near = (F.col("id") % 4000 == 7) & (F.col("id") < 48_000)
    d = d.withColumn("x", F.when(near, F.col("x") + 0.6 + F.col("id") / 400_000).otherwise(F.col("x")))
    got = similar.similarity(d.select(F.format_string("e%06d", "id").alias("entity"), F.array("x", "y", "z").alias("v"))).collect()
    want = sorted(((0.4 - i / 400_000, f"e{i:06d}", f"e{i + 1:06d}") for i in range(7, 48_000, 4000)))
    assert [(r["left"], r["right"]) for r in got] == [(a, b) for _, a, b in want]
    assert [r["distance"] for r in got] == pytest.approx([x for x, *_ in want])
    most = np.sqrt(49**2 + 39**2 + 24**2)
    assert got[0]["similarity"] == pytest.approx(1 - want[0][0] / most)


def plain_kmeans(points, k, restarts, u):
    """k-means with the same draws u[restart][step][entity]."""
    best = None
    for r in range(restarts):
        centres = []
        for step in range(k):
            d2 = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) if centres else np.ones(len(points))
            race = [(-np.log(u[r][step][i]) / d2[i], i) for i in range(len(points)) if d2[i] > 0] or [(u[r][step][i], i) for i in range(len(points))]
            centres.append(points[min(race)[1]])
        at, old = np.array(centres), None
        for _ in range(300):
            d = ((points[:, None, :] - at) ** 2).sum(axis=2)
            label = d.argmin(axis=1)
            if old is not None and (label == old).all():
                break
            old, far = label, sorted(range(len(points)), key=lambda i: (-d[i].min(), i))
            at = np.array([points[label == c].mean(axis=0) if (label == c).any() else points[far.pop(0)] for c in range(k)])
        inertia = ((points - at[label]) ** 2).sum()
        if best is None or inertia < best[0] - 1e-9:
            best = (inertia, label)
    return best


@pytest.mark.parametrize(("name", "k"), [("cloud", 4), ("copies", 6), ("three", 2)])
def test_kmeans(spark, name, k):
    """Equal partitions to the plain version; "copies" with 6 clusters has but four places, so centres stay empty."""
    points, restarts = clouds()[name], 3
    f = frame(spark, points)
    u = [[[r["u"] for r in f.select("entity", similar._keyed(F.col("entity"), 1, r, s).alias("u")).orderBy("entity").collect()] for s in range(k)] for r in range(restarts)]
    inertia, label = plain_kmeans(points, k, restarts, u)
    got = {r["entity"]: r["cluster"] for r in similar.cluster(f, k, restarts).collect()}
    first = {}
    for i, c in enumerate(label):
        first.setdefault(c, len(first))
        assert got[f"e{i:06d}"] == first[c]
    assert similar.fit(f, k, restarts)[1] == pytest.approx(inertia, abs=1e-9)
    assert similar.cluster(f, 1).count() == 0 and similar.cluster(f.limit(k - 1), k).count() == 0


def test_an_empty_cluster_moves_to_the_farthest(spark, monkeypatch):
    """Two centres drawn in one place: the empty one takes the outlier."""
    points = np.array([(x / 10, 0) for x in range(20)] + [(50, 50), (50.5, 50)], float)
    monkeypatch.setattr(similar, "_drawn", lambda *a: [[[0.0, 0.0], [0.0, 0.0]]])
    got = {r["entity"]: r["cluster"] for r in similar.cluster(frame(spark, points), 2, 1).collect()}
    assert [got[f"e{i:06d}"] for i in range(22)] == [0] * 20 + [1, 1]


@pytest.mark.parametrize("size", [7, 512])
def test_silhouette_in_blocks(spark, size):
    rng = random.Random(4)
    points = np.concatenate([clouds()["cloud"][:80], [[9, 9, 9]]])
    label = [rng.randrange(3) for _ in range(80)] + [7]
    f = frame(spark, points)
    c = spark.createDataFrame([(f"e{i:06d}", x) for i, x in enumerate(label)], "entity string, cluster int")
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    values, means = [], {}
    for i, own in enumerate(label):
        for o in set(label):
            others = [j for j, x in enumerate(label) if x == o and j != i]
            if others:
                means[f"e{i:06d}", own, o] = d[i, others].mean()
        mine, near = means.get((f"e{i:06d}", own, own)), min(means[f"e{i:06d}", own, o] for o in set(label) if o != own)
        if mine is not None:
            values.append((near - mine) / max(near, mine))
    got = {(r["entity"], r["cluster"], r["other"]): r["m"] for r in similar.mean_distances(f, c, size).collect()}
    assert got.keys() == means.keys() and all(got[k] == pytest.approx(means[k]) for k in means)
    s = similar.silhouette(f, c, size).first()
    assert s["silhouette"] == pytest.approx(np.mean(values)) and s["n"] == 80
