"""Joins between series, dimensions and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake import rounds
from aerolake.functions.standards import haversine_km


def fuse(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; columns of both are taken from the first if it has them."""
    both = [c for c in first.columns if c in second.columns and c not in keys]
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, keys, "full_outer")
    rest = [c for c in [*first.columns, *second.columns] if c not in keys and c not in both]
    return joined.select(*keys, *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in both), *rest)


#: A cell is cut further while it holds more candidates than this, up to so many times (the last cells are some 10 m wide).
FEW, MOST_CUTS = 64, 10


def _on_sphere(lat: str, lon: str) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def _cell(axes: list[str], cuts: int) -> list[Column]:
    """The cell of a point of the cube around the unit sphere, 4 ** cuts of them on each edge."""
    n = 4**cuts
    return [F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(x) + 1) / 2 * n))).cast("int").alias(f"_{x}") for x in axes]


def nearest(points: DataFrame, candidates: DataFrame, most_km: float = 100.0) -> DataFrame:
    """id, cand_id and km of the candidate (cand_id, lat, lon) nearest to each point (id, lat, lon), the least cand_id
    among equals, and ``far``: it lies beyond ``most_km`` or there is none. Points and candidates without a place take no part;
    such a point is far.

    Places are points of the unit sphere, so poles and the 180th meridian are places as any other. The candidates fall
    into cells of a cube, cut in 64 until a cell holds FEW of them. Each point begins with the whole cube; at every cut it
    goes on with the cells that may hold its nearest candidate: those not farther away than some candidate that
    it has met. So a point meets few candidates, however far they are, and no two large sides meet."""
    axes = ["x", "y", "z"]
    # Of candidates in one place the least is the answer.
    c = candidates.where("cand_id IS NOT NULL").select("cand_id", F.col("lat").cast("double").alias("c_lat"), F.col("lon").cast("double").alias("c_lon")).dropna()
    c = c.groupBy("c_lat", "c_lon").agg(F.min("cand_id").alias("cand_id"))
    c = rounds.cut(c.withColumns({f"c{x}": v for x, v in zip(axes, _on_sphere("c_lat", "c_lon"), strict=True)}))
    p = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    placed = rounds.cut(p.dropna().dropDuplicates(["lat", "lon"]).select("lat", "lon").withColumns(dict(zip(axes, _on_sphere("lat", "lon"), strict=True))))
    pairs, cuts = placed.withColumns({f"_{x}": F.lit(0) for x in axes}), 0
    apart = sum(((F.col(x) - F.col(f"c{x}")) * (F.col(x) - F.col(f"c{x}")) for x in axes), F.lit(0.0))
    key, at = [f"_{x}" for x in axes], ["lat", "lon"]
    cells = lambda n: c.withColumns({f"_{x}": v for x, v in zip(axes, _cell([f"c{x}" for x in axes], n), strict=True)})
    crowd = c.count()
    while crowd > FEW and cuts < MOST_CUTS:
        cuts += 1
        # One candidate of each cell, beside the cell above it.
        one = cells(cuts).groupBy(*key).agg(F.min_by(F.struct(*(f"c{x}" for x in axes)), "cand_id").alias("one"), F.count("*").alias("n"))
        one = rounds.cut(one.select(*(F.floor(F.col(k) / 4).cast("int").alias(k) for k in key), *(F.col(k).alias(f"in{k}") for k in key), "one.*", "n"))
        crowd = one.agg(F.max("n")).first()[0]
        d = pairs.join(rounds.small(one.drop("n")), key).drop(*key).withColumn("_met", apart)
        side = 2.0 / 4**cuts
        gap = lambda x: F.greatest(F.lit(0.0), F.col(f"in_{x}") * side - 1 - F.col(x), F.col(x) - ((F.col(f"in_{x}") + 1) * side - 1))  # noqa: B023, E731
        d = d.withColumn("_least", sum((gap(x) * gap(x) for x in axes), F.lit(0.0)))
        # A little more than the best: what rounding could have turned around stays.
        best = F.min("_met").over(Window.partitionBy(*at)) * (1 + 1e-9) + 1e-18
        d = d.withColumn("_best", best).where(F.col("_least") <= F.col("_best"))
        pairs = rounds.cut(d.select(*at, *axes, *(F.col(f"in{k}").alias(k) for k in key)))
    d = pairs.join(rounds.small(rounds.cut(cells(cuts))), key).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")))
    found = d.groupBy(*at).agg(F.min_by("cand_id", F.struct("km", "cand_id")).alias("cand_id"), F.min("km").alias("km"))
    return p.join(found, at, "left").select("id", "cand_id", "km", (F.coalesce(F.col("km"), F.lit(float("inf"))) > most_km).alias("far"))


def superseded(df: DataFrame, by: list[str], number: str, age: str, oldest) -> DataFrame:
    """Rows older than ``oldest`` that aren't the newest (largest number) of their group."""
    newest = df.groupBy(*by).agg(F.max(number).alias(number))
    return df.where(F.col(age) < oldest).join(newest, [*by, number], "left_anti")


def sync(have: DataFrame, want: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What makes ``have`` into ``want``: create, update, delete or keep, by key."""
    h, w = have.select(*keys, F.col(value).alias("old"), F.lit(1).alias("in_h")), want.select(*keys, F.col(value).alias("new"), F.lit(1).alias("in_w"))
    action = F.when(F.col("in_h").isNull(), "create").when(F.col("in_w").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return h.join(w, keys, "full_outer").select(*keys, "old", "new", action.alias("action"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last arrival of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
