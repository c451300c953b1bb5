"""Quantiles, places, ranks and series in pieces: the same results, however large a group is."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolake.operators import patterns, places, stats


def samples():
    rng = random.Random(7)
    return {
        "even": [float(i) for i in range(3000)],
        "skewed": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(4000)],
        "tied": [rng.choice([0.0, 1.0, 1.0, 1.0, 2.0]) for _ in range(3000)],
        "two heaps": [1.0] * 2000 + [rng.uniform(1, 2) for _ in range(301)] + [2.0] * 2000,
        "constant": [5.5] * 1000,
        "one": [3.0],
        "two": [1.0, 2.0],
        None: [rng.gauss(0, 1) for _ in range(999)],
        "exact": [rng.expovariate(1) for _ in range(1001)],
    }


@pytest.mark.parametrize(("most", "points"), [(10_000, 256), (20, 8)])
def test_quantiles(spark, most, points):
    rows = [(k, v, "c") for k, vs in samples().items() for v in vs] + [("even", None, "c"), ("nothing", None, "c")]
    df = spark.createDataFrame(rows, "k string, v double, rank string").repartition(5).cache()
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    want = {r["k"]: r["q"] for r in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.lit(probs)).alias("q")).collect()}
    got = {r["k"]: r["q"] for r in places.quantiles(df, "v", ["k"], probs, most, points).collect()}
    assert set(got) == set(want) == set(samples())
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k
    whole = places.quantiles(df, "v", [], [0.5], most, points).first()["q"]
    assert whole == pytest.approx(df.agg(F.percentile("v", F.lit([0.5])).alias("q")).first()["q"])
    assert places.quantiles(df.where("false"), "v", ["k"], probs).count() == 0
    mixed = {r["k"]: r["q"] for r in places.percentiles(df, "v", ["k"], probs, hot=1001).collect()}
    assert set(mixed) == set(want) and all(mixed[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_statistics_of_hot_groups(spark, monkeypatch):
    """Descriptions, boxes, robust scores and profiles are the same with selected quantiles."""
    rows = [(k or "none", v if abs(v) < 1e6 else 1.0, float(i % 7)) for k, vs in samples().items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, v double, w double").cache()
    flat = lambda d: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in d.collect())
    make = lambda: [flat(stats.describe(df, "v", ["k"])), flat(stats.boxplot(df, "v", ["k"])), flat(stats.robust_z(df, "v", ["k"])), flat(stats.column_profile(df, ["v", "w"], {"w": (1, 5)}))]
    plain = make()
    monkeypatch.setattr(places, "HOT", 500)
    assert make() == plain


@pytest.mark.parametrize("hot", [10, 2_000_000])
def test_ranks(spark, monkeypatch, hot):
    monkeypatch.setattr(places, "HOT", hot)
    rows = [(k, v, float(i % 5)) for k, vs in samples().items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, v double, w double").cache()
    own = lambda c: F.rank().over(Window.partitionBy("k").orderBy(c)) + (F.count("*").over(Window.partitionBy("k", c)) - 1) / 2.0
    want = df.select("k", "v", "w", own("v").alias("rank_v"), own("w").alias("rank_w"))
    got = stats.average_ranks(df, ["v", "w"], ["k"]).select("k", "v", "w", "rank_v", "rank_w")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def series(spark):
    rng = random.Random(11)
    rows = []
    for e, n in (("long", 6400), ("short", 9), (None, 70), ("flat", 300)):
        v = 50.0
        for t in range(n):
            v = max(0.0, v + rng.gauss(0, 6))
            rows.append((e, t * 3 + (t % 2), None if rng.random() < 0.02 else 100.0 if e == "flat" else v, float(rng.randrange(9))))
    return spark.createDataFrame(rows, "entity string, time long, value double, p_ double").repartition(6).cache(), rows


@pytest.mark.parametrize(("piece", "hot"), [(100, 10), (100_000, 2_000_000)])
def test_trailing_means_in_pieces(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(places, "HOT", hot)
    df, _ = series(spark)
    got = patterns.trailing_means(df, {"a": ("value", 24), "b": ("p_", 8)}, piece=piece)
    assert sorted(got.columns) == sorted([*df.columns, "a", "b"])
    want = df.withColumns({"a": patterns.trailing_mean(F.col("value"), 24), "b": patterns.trailing_mean(F.col("p_"), 8)})
    key = lambda r: (str(r["entity"]), r["time"])
    for x, y in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert (x["entity"], x["time"]) == (y["entity"], y["time"]) and (x["a"] == pytest.approx(y["a"]) if y["a"] is not None else x["a"] is None) and (x["b"] == pytest.approx(y["b"]) if y["b"] is not None else x["b"] is None)


@pytest.mark.parametrize(("piece", "threshold", "hot"), [(4, 40.0, 10), (100, 40.0, 2_000_000), (100_000, 40.0, 10), (100, -1.0, 10), (100, 1e9, 10)])
def test_episodes_in_pieces(spark, monkeypatch, piece, threshold, hot):
    """A series in 64 and more pieces; episodes over several pieces, bridges over borders, and none at all."""
    monkeypatch.setattr(places, "HOT", hot)
    df, rows = series(spark)
    want = set()
    for e in {r[0] for r in rows}:
        own = sorted((t, v) for k, t, v, _ in rows if k == e and v is not None)
        hits = [i for i, (_, v) in enumerate(own) if v > threshold]
        runs = []
        for i in hits:
            if runs and i - runs[-1][1] - 1 <= 3:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for a, z in runs:
            if z - a + 1 >= 2:
                vs = [v for _, v in own[a : z + 1]]
                want.add((e, own[a][0], own[z][0], z - a + 1, max(vs), own[a + vs.index(max(vs))][0], round(sum(vs) / len(vs), 6), sum(v > threshold for v in vs)))
    got = patterns.episodes(df, threshold, piece=piece).collect()
    assert {(r["entity"], r["start_time"], r["end_time"], r["duration"], r["peak"], r["peak_time"], round(r["mean"], 6), r["n_over"]) for r in got} == want and len(got) == len(want)
    order = sorted(got, key=lambda r: (-r["peak"], -r["duration"], r["entity"] is not None, r["entity"] or "", r["start_time"]))
    assert [r["place"] for r in order] == list(range(1, len(got) + 1))


def test_no_task_gets_a_whole_group(spark, monkeypatch):
    """One entity with all rows: its rows lie in many tasks after the numbering."""
    monkeypatch.setattr(places, "HOT", 10)
    df = spark.range(0, 50_000, 1, 8).select(F.lit("one").alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in places.numbered(df, ["k"], ["t"]).withColumn("part", F.expr("p % 1")).groupBy(F.floor((F.col("p") - 1) / 1000)).count().collect()]
    assert sizes == [1000] * 50
    d = df.repartitionByRange(8, "k", "t").groupBy(F.spark_partition_id()).count()
    assert d.agg(F.max("count")).first()[0] < 12_000
