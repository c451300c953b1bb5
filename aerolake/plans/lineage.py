"""Lineage graphs: depth, traces and summaries over edges (upstream, downstream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake import rounds


def edges(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A table of edges from rows of a configuration: upstream, downstream, transform."""
    return spark.createDataFrame(rows, "upstream string, downstream string, transform string")


def depths(e: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and depth: the longest path from a source. Nodes (column node, if given) without an edge have depth 0, as
    have nodes on a circle; what only a circle feeds keeps the depth that its other edges give it.

    Nodes with one edge from above hang on the nearest node that has none or several (found by doubling the way up, so
    a chain takes as many rounds as its length has bits); of the others, each round takes those all of whose
    edges come from nodes already taken, so the rounds are as many as levels where ways meet, however many ways there
    are. Repeated edges count once."""
    e = e.where("upstream IS NOT NULL AND downstream IS NOT NULL").select("upstream", "downstream").distinct()
    every = e.select(F.col("upstream").alias("node")).unionAll(e.select("downstream"))
    every = (every if nodes is None else every.unionAll(nodes.select("node").where("node IS NOT NULL"))).distinct()
    above = e.groupBy(F.col("downstream").alias("node")).agg(F.count("*").alias("ways"), F.min("upstream").alias("only"))
    # A node that hangs: its next known node on the way up, and how far that is. Others stand for themselves.
    hang = F.col("ways") == 1
    up = rounds.cut(every.join(above, "node", "left").select("node", F.coalesce("ways", F.lit(0)).alias("ways"), F.when(hang, F.col("only")).otherwise(F.col("node")).alias("root"), F.when(hang, 1).otherwise(0).alias("hops"), hang.alias("open")).fillna(False, ["open"]))
    open_ = up.where("open").count()
    for _ in range(open_.bit_length() + 1):
        if not open_:
            break
        onward = up.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("hops").alias("_hops"), F.col("ways").alias("_ways"), F.col("open").alias("_open"))
        d = up.join(onward, "root", "left")
        more = F.col("open") & (F.col("_ways") == 1)
        up = rounds.cut(d.select("node", "ways", F.when(more, F.col("_root")).otherwise(F.col("root")).alias("root"), F.when(more, F.col("hops") + F.col("_hops")).otherwise(F.col("hops")).alias("hops"), (more & F.col("_open")).alias("open")))
        left = up.where("open").count()
        if left == open_:
            break  # circles alone are left: on a chain someone arrives in every round
        open_ = left
    # Edges between nodes that stand for themselves, as long as the way they stand for.
    joint = F.col("ways") != 1
    roots = up.where("NOT open").select(F.col("node").alias("upstream"), "root", (F.col("hops") + 1).alias("length"))
    w = e.join(up.where(joint).select(F.col("node").alias("downstream")), "downstream").join(roots, "upstream")
    w = rounds.cut(w.groupBy("root", "downstream").agg(F.max("length").alias("length"), F.count("*").alias("n")))
    state = rounds.cut(up.where(joint).select("node", F.col("ways").alias("left"), F.lit(0).alias("depth"), F.when(F.col("ways") == 0, 0).alias("taken")))
    level = 0
    while not state.where(F.col("taken") == level).isEmpty():
        front = state.where(F.col("taken") == level).select(F.col("node").alias("root"), F.col("depth").alias("from"))
        got = w.join(front, "root").groupBy(F.col("downstream").alias("node")).agg(F.max(F.col("from") + F.col("length")).alias("far"), F.sum("n").alias("n"))
        level += 1
        left = F.col("left") - F.coalesce("n", F.lit(0))
        state = state.join(got, "node", "left").select("node", left.alias("left"), F.greatest("depth", F.coalesce("far", F.lit(0))).cast("int").alias("depth"), F.coalesce("taken", F.when(left <= 0, level)).alias("taken"))
        state = rounds.cut(state)
    taken = state.where("taken IS NOT NULL").select(F.col("node").alias("root"), "depth")
    hanging = up.where(~joint).join(taken, "root", "left").select("node", F.when(F.col("open"), 0).otherwise(F.coalesce(F.col("depth") + F.col("hops"), F.lit(0))).cast("int").alias("depth"))
    return state.select("node", "depth").unionByName(hanging)


def trace(e: DataFrame, node: str, direction: str = "down", most: int = 10) -> DataFrame:
    """Nodes reached from ``node`` down, up or both ways, and the fewest steps, level by level. Edges and levels are
    tables of their own, so that a level's plan holds those before it as scans, not as plans that double each time."""
    ways = {"down": [("upstream", "downstream")], "up": [("downstream", "upstream")], "both": [("upstream", "downstream"), ("downstream", "upstream")]}[direction]
    step = e.select(F.col(ways[0][0]).alias("a"), F.col(ways[0][1]).alias("b"))
    for a, b in ways[1:]:
        step = step.unionAll(e.select(F.col(a).alias("a"), F.col(b).alias("b")))
    step = rounds.cut(step.distinct())
    seen = front = e.sparkSession.range(1).select(F.lit(node).alias("node"), F.lit(0).alias("level"))
    for level in range(1, most + 1):
        front = front.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = rounds.cut(front.select("node", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def degrees(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Each node (column node) with its numbers of edges from above and to below."""
    up = e.groupBy(F.col("downstream").alias("node")).agg(F.count("*").alias("upstream_count"))
    down = e.groupBy(F.col("upstream").alias("node")).agg(F.count("*").alias("downstream_count"))
    return nodes.select("node").join(up, "node", "left").join(down, "node", "left").fillna(0)


def summary(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """One row: nodes, edges, sources, sinks, isolated nodes, mean edges from above, and edges by transform."""
    up, down = F.col("upstream_count"), F.col("downstream_count")
    d = degrees(nodes, e).agg(F.count("*").alias("nodes"), F.count_if((up == 0) & (down > 0)).alias("sources"), F.count_if((down == 0) & (up > 0)).alias("sinks"), F.count_if((up == 0) & (down == 0)).alias("isolated"), F.round(F.coalesce(F.avg(up), F.lit(0.0)), 2).alias("avg_upstream"))
    kinds = e.groupBy("transform").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("transform", "n")))).alias("transforms"))  # kinds of transforms
    return d.crossJoin(kinds)  # one row each


def orphans(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return degrees(nodes, e).where("upstream_count = 0 AND downstream_count = 0").select("node")
