"""Lineage depths and nearest places against brute force."""

import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from aerolake.operators import joins
from aerolake.plans import lineage


def brute_depths(edges, nodes):
    edges = set(edges)
    into, out = defaultdict(set), defaultdict(set)
    for a, b in edges:
        into[b].add(a)
        out[a].add(b)
    every = set(nodes) | set(into) | set(out)
    left = {n: len(into[n]) for n in every}
    depth = dict.fromkeys(every, 0)
    queue = deque(n for n in every if not left[n])
    while queue:
        n = queue.popleft()
        for m in out[n]:
            depth[m] = max(depth[m], depth[n] + 1)
            left[m] -= 1
            if not left[m]:
                queue.append(m)
    return depth


def graphs():
    rng = random.Random(1)
    diamonds = [e for k in range(12) for e in ((f"d{k}", f"l{k}"), (f"d{k}", f"r{k}"), (f"l{k}", f"d{k + 1}"), (f"r{k}", f"d{k + 1}"))]
    chain = [(f"c{k}", f"c{k + 1}") for k in range(300)]
    circle = [("a", "b"), ("b", "c"), ("c", "a"), ("s", "b"), ("t", "s"), ("c", "tail"), ("tail", "tail2"), ("u", "tail3"), ("tail2", "tail3"), ("self", "self"), ("s", "self2"), ("self2", "self2"), ("x", "y"), ("y", "x")]
    mixed = [(f"n{i}", f"n{j}") for i, j in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if i < j or rng.random() < 0.03]
    return {"diamonds": diamonds, "chain": chain, "circle": circle, "mixed": mixed, "all": diamonds + chain + circle + mixed, "none": []}


@pytest.mark.parametrize("kind", ["all", "circle", "none"])
def test_depths(spark, kind):
    edges = graphs()[kind]
    e = lineage.edges(spark, [(a, b, "t") for a, b in edges + edges[:3]])
    nodes = spark.createDataFrame([("lonely",), ("d0",), ("lonely",)], "node string")
    got = lineage.depths(e, nodes).collect()
    assert {r["node"]: r["depth"] for r in got} == brute_depths(edges, ["lonely", "d0"]) and len(got) == len({r["node"] for r in got})
    if kind == "none":
        assert lineage.depths(e).count() == 0


def brute_trace(edges, node, direction, most):
    near = defaultdict(set)
    for a, b in edges:
        if direction != "up":
            near[a].add(b)
        if direction != "down":
            near[b].add(a)
    level, front = {node: 0}, [node]
    for k in range(1, most + 1):
        front = {m for n in front for m in near[n]} - set(level)
        level |= dict.fromkeys(front, k)
    return level


@pytest.mark.parametrize(("node", "direction", "most"), [("c20", "both", 5), ("d3", "down", 3), ("tail3", "up", 10), ("nowhere", "both", 4)])
def test_trace(spark, node, direction, most):
    edges = graphs()["all"]
    e = lineage.edges(spark, [(a, b, "t") for a, b in edges + edges[:3]])
    traced = lineage.trace(e, node, direction, most)
    got = traced.collect()
    assert {r["node"]: r["level"] for r in got} == brute_trace(edges, node, direction, most) and len(got) == len({r["node"] for r in got})
    assert "Join" not in traced._jdf.queryExecution().optimizedPlan().toString()  # else a level's plan holds those before it twice


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize(("n", "few"), [(0, 64), (1, 1), (500, 8)])
def test_nearest(spark, monkeypatch, n, few):
    """Poles, both sides of the 180th meridian, a city full of candidates, points far from all, repeated places."""
    monkeypatch.setattr(joins, "FEW", few)
    rng = random.Random(n)
    city = [(48.0 + rng.random() / 50, 2.0 + rng.random() / 50) for _ in range(n // 2)]
    places = [*city, *((rng.uniform(-60, 60), rng.uniform(-180, 180)) for _ in range(n // 4)), *([(90.0, 10.0), (-89.9, 5.0), (10.0, 179.99), (10.0, -179.98), (48.0, 2.0), (48.0, 2.0)] if n > 1 else [(0.0, 0.0)] * n)]
    cands = list(enumerate(places, 100))
    points = [(90.0, -170.0), (89.99, 100.0), (-90.0, 0.0), (10.0, 180.0), (10.001, -180.0), (48.005, 2.01), (-48.0, -178.0), (0.0, 0.0), (-0.0, 0.0), (48.0, 2.0), (None, 3.0), (5.0, float("nan"))]
    points += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(48.0 + rng.random() / 40, 2.0 + rng.random() / 40) for _ in range(40)]
    p = spark.createDataFrame([(i, *x, "c") for i, x in enumerate(points)], "id int, lat double, lon double, cand_id string")
    c = spark.createDataFrame([(i, *x) for i, x in cands] + [(999, None, 1.0), (None, 48.0, 2.0)], "cand_id int, lat double, lon double")
    got = {r["id"]: r for r in joins.nearest(p, c, 300.0).collect()}
    assert len(got) == len(points)
    for i, x in enumerate(points):
        r = got[i]
        if None in x or math.nan in x or math.isnan(x[1]) or not cands:
            assert (r["cand_id"], r["km"], r["far"]) == (None, None, True)
            continue
        best = min(km(x, y) for _, y in cands)
        assert r["km"] == pytest.approx(best, abs=1e-6) and r["far"] == (best > 300.0)
        assert r["cand_id"] == min(k for k, y in cands if km(x, y) <= best + 1e-9)


def test_nearest_forms_few_pairs(spark):
    """20,000 points of one city far from 20,000 candidates of another meet few of them."""
    points = spark.range(20_000).select("id", (F.col("id") % 200 / 4000 + 60).alias("lat"), (F.col("id") / 200 / 4000).alias("lon"))
    cands = spark.range(20_000).select(F.col("id").alias("cand_id"), (F.col("id") % 200 / 4000 - 60).alias("lat"), (F.col("id") / 200 / 4000).alias("lon"))
    got = joins.nearest(points, cands)
    assert got.where("far AND km > 13000").count() == 20_000
    last = got.agg(F.countDistinct("cand_id")).first()[0]
    assert 1 <= last <= 400
