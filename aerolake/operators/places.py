"""Places and quantiles within groups of any size: no task puts a whole group in order.

Rows are dealt by ranges of (group, order), so one large group lies in many tasks; what the ranges hold of each group is
counted, and the sums over the ranges before are added to the places within a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from aerolake import rounds

#: Rows of a group up to which its values may meet in one buffer.
HOT = 2_000_000


def on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys that may be null; the keys are a's."""
    b = b.select(*(F.col(k).alias(f"_on_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys), F.lit(True))
    return a.join(b, same, how).drop(*(f"_on_{k}" for k in keys))


def summed(df: DataFrame, by: list[str], order: list[str], amount: Column, before: str, total: str | None = None) -> DataFrame:
    """df, computed once, with the sum of ``amount`` over the rows before in the group's order (``before``), and over the
    whole group (``total``). Rows that are equal in ``order`` come in any order; nulls first."""
    d = rounds.cut(df.withColumn("_a", amount).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = d.groupBy(*by, "_part").agg(F.sum("_a").alias("_n"))
    group = Window.partitionBy(*by)  # a row for each range that holds some of the group
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("_whole"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = on(d.withColumn("_in", F.coalesce(F.sum("_a").over(within), F.lit(0))), sizes, [*by, "_part"])
    d = d.withColumn(before, F.col("_base") + F.col("_in"))
    return (d.withColumn(total, F.col("_whole")) if total else d).drop("_a", "_part", "_in", "_base", "_whole")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "p", total: str | None = None) -> DataFrame:
    """df with the number (from 1) of each row in its group's order, and the rows of the group. Groups of up to HOT rows
    are numbered by plain windows."""
    if by and largest(df, by) <= HOT:
        d = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
        return d.withColumn(total, F.count("*").over(Window.partitionBy(*by))) if total else d
    d = summed(df, by, order, F.lit(1), name, total)
    return d.withColumn(name, F.col(name) + 1)


def chunked(df: DataFrame, p: str, size: int, back: int, ahead: int = 0) -> DataFrame:
    """df in chunks (column ``_chunk``) of ``size`` consecutive places, with the ``back`` rows before and the ``ahead`` rows behind each as
    copies (column ``_own`` is false)."""
    if max(back, ahead) > size:
        raise ValueError("a chunk must be as long as what it looks at")
    own, at = F.floor((F.col(p) - 1) / size), (F.col(p) - 1) % size
    into = F.array_compact(F.array(own, F.when(at >= size - back, own + 1), F.when((at < ahead) & (own > 0), own - 1)))
    return df.withColumn("_chunk", F.explode(into)).withColumn("_own", F.col("_chunk") == own)


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group; 0 for none."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _ranks(n: Column, probs: list[float]) -> Column:
    """The ranks, from 0, between which the quantiles lie."""
    at = [(n - 1) * p for p in probs]
    return F.array_distinct(F.array(*(f(x).cast("bigint") for x in at for f in (F.floor, F.ceil))))


def quantiles(df: DataFrame, value: str, by: list[str], probs: list[float], most: int = 10_000, points: int = 256) -> DataFrame:
    """by and ``q``, the exact quantiles (linear between ranks, as ``percentile``) of the values that aren't null.

    Every rank begins between no bounds. A pass takes ``points`` bounds between a rank's own bounds from a sketch of the
    values there, a second one counts what lies at and between the new bounds: the rank is then at a bound, and known,
    or between two neighbours that hold about 2 / points of the values. When no more than ``most`` values are
    left around a rank they are put in order. A task holds sketches, counts and at most ``most`` values of a rank, whatever the
    sizes of groups, repeated values and skew; a pass over 10^12 rows leaves some 10^10, the next one 10^8."""
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    n = rounds.cut(d.groupBy(*by).agg(F.count("*").alias("n")))
    todo = n.select(*by, F.explode(_ranks(F.col("n"), probs)).alias("rank"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("bigint").alias("before"), F.col("n").alias("inside"))
    todo, found, grid = rounds.cut(todo), [], [i / points for i in range(points + 1)]
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    ends = ["lo", "hi"]
    while (held := todo.agg(F.max("inside"), F.count("*")).first())[1]:
        # Few values around a rank: all of them, in order.
        few = todo.where(F.col("inside") <= most)
        gaps = rounds.small(rounds.cut(few.select(*by, *ends).distinct()))
        values = on(d, gaps, by).where(inside).groupBy(*by, *ends).agg(F.sort_array(F.collect_list("v")).alias("values"))
        found.append(rounds.cut(on(few, values, [*by, *ends]).select(*by, "rank", F.get("values", (F.col("rank") - F.col("before")).cast("int")).alias("at"))))
        if held[0] <= most:
            break
        many = todo.where(F.col("inside") > most)
        gaps = rounds.small(rounds.cut(many.select(*by, *ends, "before").distinct()))
        near = on(d, gaps, by).where(inside)
        bounds = near.groupBy(*by, *ends, "before").agg(F.array_distinct(F.percentile_approx("v", F.lit(grid), F.lit(10 * points))).alias("b"))
        bounds = rounds.small(rounds.cut(bounds))
        # Slot 2 j: at bound j; 2 j - 1: below it and above the one before.
        place = InternalFunction.array_binary_search(F.col("b"), F.col("v"))
        slot = F.when(place >= 0, 2 * place).otherwise(2 * (-place - 1) - 1)
        near = on(d, bounds, by).where(inside)
        slots = near.groupBy(*by, *ends, "before", slot.alias("slot")).agg(F.count("*").alias("c"), F.any_value("b").alias("b"))
        w = Window.partitionBy(*by, *ends).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # 2 * points rows at most
        slots = slots.withColumn("under", F.col("before") + F.coalesce(F.sum("c").over(w), F.lit(0)))
        hit = on(many.drop("before", "inside"), slots, [*by, *ends]).where((F.col("rank") >= F.col("under")) & (F.col("rank") < F.col("under") + F.col("c")))
        hit = rounds.cut(hit)
        half = F.floor((F.col("slot") + 1) / 2).cast("int")
        found.append(hit.where("slot % 2 = 0").select(*by, "rank", F.get("b", half).alias("at")))
        todo = rounds.cut(hit.where("slot % 2 <> 0").select(*by, "rank", F.get("b", half - 1).alias("lo"), F.get("b", half).alias("hi"), F.col("under").alias("before"), F.col("c").alias("inside")))
    if not found:
        return n.select(*by, F.array().cast("array<double>").alias("q"))
    every = reduce(DataFrame.unionByName, found).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at"))  # two for each quantile
    d = on(n, every, by)

    def between(p: float) -> Column:
        x = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.element_at("at", F.floor(x).cast("bigint")), F.element_at("at", F.ceil(x).cast("bigint"))
        return F.when((F.floor(x) == F.ceil(x)) | (lo == hi), lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)

    return d.select(*by, F.array(*(between(p) for p in probs)).alias("q"))


def percentiles(df: DataFrame, value: str, by: list[str], probs: list[float], hot: int | None = None) -> DataFrame:
    """by and ``q``, exact quantiles of the values that aren't null: in one buffer for groups of up to ``hot`` rows, by selection for
    larger ones."""
    hot = HOT if hot is None else hot
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    plain = lambda x: x.groupBy(*by).agg(F.percentile("_v", F.lit(probs)).alias("q"))
    sizes = d.groupBy(*by).agg(F.count("*").alias("_n"))
    if not by or (sizes.agg(F.max("_n")).first()[0] or 0) <= hot:
        return plain(d) if by else quantiles(d, "_v", by, probs) if d.count() > hot else plain(d)
    sizes = rounds.small(rounds.cut(sizes))
    return plain(on(d, sizes.where(F.col("_n") <= hot).drop("_n"), by)).unionByName(quantiles(on(d, sizes.where(F.col("_n") > hot).drop("_n"), by), "_v", by, probs))
