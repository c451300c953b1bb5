"""Time patterns of entity-keyed series with columns entity, time and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake import rounds
from aerolake.operators import places

#: Rows of a series that lie in one piece where series are cut.
PIECE = 100_000


def hour(ts: Column) -> Column:
    """The hour of a time without zone, without zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def latest(df: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """The first row of each group in the order given."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def trailing_mean(value: Column, rows: int, by: str = "entity", time: str = "time") -> Column:
    """Mean of the last ``rows`` rows, null unless all of them have a value."""
    w = Window.partitionBy(by).orderBy(time).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def trailing_means(df: DataFrame, means: dict[str, tuple[str, int]], by: str = "entity", time: str = "time", piece: int = PIECE) -> DataFrame:
    """df with means of the last n rows, by name a column and its n; null unless all n have a value. A series is cut in
    pieces of ``piece`` rows, each with copies of the n - 1 rows before it, so that no series is one task's."""
    back = max(n for _, n in means.values()) - 1
    d = places.chunked(places.numbered(df, [by], [time], "_p"), "_p", max(piece, back), back)
    frame = lambda n: Window.partitionBy(by, "_chunk").orderBy("_p").rowsBetween(1 - n, 0)
    d = d.withColumns({k: F.when(F.count(c).over(frame(n)) == n, F.avg(c).over(frame(n))) for k, (c, n) in means.items()})
    return d.where("_own").drop("_p", "_chunk", "_own")


def episodes(df: DataFrame, threshold: float, gap: int = 3, shortest: int = 2, facts: dict[str, Column] | None = None, rank: bool = True, piece: int = PIECE) -> DataFrame:
    """Runs of rows over the threshold, bridged over up to ``gap`` rows that are not; rows count, not
    hours. A series is cut in pieces of ``piece`` rows with copies of the gap + 1 rows on either side, which tell what
    is a run, a bridge and a beginning; episodes are numbered by the beginnings in the pieces before. ``facts`` are
    further aggregates over an episode's rows. Ranked by peak and duration through a range of the peaks;
    ``rank=False`` leaves that to the caller, with series_rows (of the entity)."""
    d = places.numbered(df.where("value IS NOT NULL"), ["entity"], ["time"], "p", "series_rows")
    d = places.chunked(d, "p", max(piece, gap + 1), gap + 1, gap + 1)
    near = Window.partitionBy("entity", "_chunk").orderBy("p")
    hit = F.when(F.col("value") > threshold, F.col("p"))
    d = d.withColumns({"_last": F.last(hit, True).over(near.rowsBetween(-gap - 1, 0)), "_next": F.first(hit, True).over(near.rowsBetween(0, gap + 1)), "_prev": F.last(hit, True).over(near.rowsBetween(-gap - 1, -1))})
    # Rows over the threshold have _last = _next = p; a bridge has at most ``gap`` rows between the two.
    d = d.where(F.col("_own") & (F.col("_next") - F.col("_last") - 1 <= gap))
    d = d.withColumn("_new", ((F.col("value") > threshold) & F.col("_prev").isNull()).cast("int"))
    # Beginnings of the pieces before: a row for each piece of a series.
    starts = d.groupBy("entity", "_chunk").agg(F.sum("_new").alias("_n"))
    starts = starts.select("entity", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("entity").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    d = places.on(d, starts, ["entity", "_chunk"]).withColumn("seg", F.col("_base") + F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    more = [c.alias(k) for k, c in (facts or {}).items()]
    out = d.groupBy("entity", "seg").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("duration"), F.max("value").alias("peak"), F.max_by("time", F.struct("value", -F.col("p"))).alias("peak_time"), F.avg("value").alias("mean"), F.count_if(F.col("value") > threshold).alias("n_over"), F.max("series_rows").alias("series_rows"), *more)
    out = out.where(F.col("duration") >= shortest).drop("seg")
    # Computed once: the ranges of the peaks and their places are two uses.
    return ranked(rounds.cut(out.drop("series_rows")), "peak", [F.desc("duration"), F.col("entity"), F.col("start_time")], "place") if rank else out


def ranked(df: DataFrame, key: str, ties: list[Column], name: str, ranges: int = 200) -> DataFrame:
    """df with the place of each row by ``key``, the largest first, nulls last, then by ``ties``. Rows fall into
    ranges of the key between its approximate quantiles (numbers on the driver, so that every use of the ranges
    sees the same ones), are numbered within each range, and each range begins after the rows of those before."""
    bounds = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / ranges)), reverse=True)
    place = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(F.size(F.filter(F.lit(bounds or [0.0]), lambda b: b > F.col(key))))
    d = df.withColumn("_range", place.cast("int"))
    sizes = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), *ties))
    return d.withColumn("_in", within).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_range", "_in", "_before")


def hour_profile(df: DataFrame) -> DataFrame:
    """Mean by entity and hour of the day, one column an hour, with peak and trough (first of equals), and
    over all entities (entity null): the mean of their means, null for an hour that one of them lacks."""
    means = df.where("value IS NOT NULL").groupBy("entity", F.hour("time").alias("h")).agg(F.avg("value").alias("m"))
    every = means.select("entity").distinct().agg(F.count("*").alias("entities"))
    overall = means.groupBy("h").agg(F.avg("m").alias("m"), F.count("*").alias("n")).join(F.broadcast(every))  # one row
    means = means.unionAll(overall.select(F.lit(None).cast("string").alias("entity"), "h", F.when(F.col("n") == F.col("entities"), F.col("m")).alias("m")))
    ends = means.groupBy("entity").agg(F.max_by(F.when(F.col("m").isNotNull(), F.col("h")), F.when(F.col("m").isNotNull(), F.struct("m", -F.col("h")))).alias("peak_hour"), F.min_by(F.when(F.col("m").isNotNull(), F.col("h")), F.when(F.col("m").isNotNull(), F.struct("m", "h"))).alias("trough_hour"), (F.max("m") - F.min("m")).alias("amplitude"))
    wide = means.groupBy("entity").pivot("h", list(range(24))).agg(F.first("m"))
    return wide.select("entity", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24))).alias("w").join(ends.alias("e"), F.col("w.entity").eqNullSafe(F.col("e.entity"))).drop(F.col("e.entity"))


def weekday_contrast(df: DataFrame) -> DataFrame:
    """Means of weekdays and weekends by entity, and their difference."""
    weekend = F.weekday("time") >= 5
    d = df.groupBy("entity").agg(F.avg(F.when(~weekend, F.col("value"))).alias("weekday_mean"), F.avg(F.when(weekend, F.col("value"))).alias("weekend_mean"))
    return d.withColumn("delta", F.col("weekend_mean") - F.col("weekday_mean"))


def monthly(df: DataFrame) -> DataFrame:
    return df.groupBy("entity", F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))


def trend(df: DataFrame, unit: str = "day") -> DataFrame:
    """Mean and rows by day or month over all entities."""
    bucket = F.to_date("time") if unit == "day" else F.to_date(F.date_trunc(unit, "time"))
    return df.groupBy(bucket.alias("bucket")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def bucketed(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Means by entity and hour or day."""
    bucket = F.date_format("time", "yyyy-MM-dd'T'HH:00") if unit == "hour" else F.date_format("time", "yyyy-MM-dd")
    return df.where("time IS NOT NULL").groupBy("entity", bucket.alias("bucket")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def compare(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.percentile("value", F.lit(0.95)).alias("p95"), F.count("*").alias("n"))


def boundary(df: DataFrame, flag: str) -> DataFrame:
    """First flagged time by entity; null if no or every row is flagged."""
    d = df.groupBy("entity").agg(F.min(F.when(F.col(flag) > 0, F.col("time"))).alias("t"), F.bool_and(F.coalesce(F.col(flag) > 0, F.lit(False))).alias("every"))
    return d.select("entity", F.when(~F.col("every"), F.col("t")).alias("boundary"))
