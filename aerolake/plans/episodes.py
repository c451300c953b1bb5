"""Pollution episodes with their facts, and the report over them.

Rows count, not hours: a row without an index doesn't exist for an episode. All facts of an episode are one aggregate
over its rows; nothing of a city is gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import standards as S
from aerolake.operators import patterns

POLLUTANTS = ["pm2_5", "pm10", "ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"]
#: Share of a city's rows beyond which an episode is a lasting state.
CHRONIC = 0.25


def episodes(df: DataFrame, value: str = "china_aqi", threshold: float = 100.0, gap: int = 3, shortest: int = 2) -> DataFrame:
    """One row an episode of df (city_id, time, value, european_aqi, pollutants and weather): bounds, hours,
    peak (the first of equals) and mean, means of the pollutants and the leading one, weather, its share of the
    window, and a grade of severity. ``place`` ranks by peak and duration."""
    d = df.withColumns({"entity": F.col("city_id"), "value": S.clean(F.col(value).cast("double"))})
    some = [c for c in POLLUTANTS if c in df.columns]
    mean = lambda c, n=2: F.round(F.avg(S.clean(F.col(c).cast("double"))), n)
    facts = {f"{c}_mean": mean(c) for c in some}
    if "european_aqi" in df.columns:
        facts["exceed_hours"] = F.count_if(F.col("european_aqi") > threshold)
    weather = {"wind_speed_avg": ("wind_speed_10m", lambda c: mean(c)), "humidity_avg": ("relative_humidity_2m", lambda c: mean(c, 1)), "precipitation_sum": ("precipitation", lambda c: F.round(F.sum(c), 2)), "stagnant_hours": ("is_stagnant", lambda c: F.sum(c).cast("bigint"))}
    facts |= {k: f(c) for k, (c, f) in weather.items() if c in df.columns}
    out = patterns.episodes(d, threshold, gap, shortest, facts, rank=False)
    out = out.withColumn("_load", S.best_load({c: F.col(f"{c}_mean") for c in some})) if some else out
    out = out.withColumns({
        "peak_level": S.china_aqi_level(F.col("peak")), "severity": S.severity(F.col("peak"), F.col("duration")),
        "window_share": F.round(100.0 * F.col("duration") / F.col("series_rows"), 1), "chronic": F.col("duration") / F.col("series_rows") > CHRONIC,
        **({"primary_pollutant": S.primary_of(F.col("_load"), some)} if some else {}),
    })
    return out.drop("_load", "series_rows").withColumnRenamed("entity", "city_id")


def ranked(found: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` episodes by peak and duration, with their place."""
    top = found.orderBy(F.desc("peak"), F.desc("duration"), "city_id", "start_time").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("peak"), F.desc("duration"), "city_id", "start_time")))  # over limit rows


def totals(found: DataFrame) -> DataFrame:
    """One row: episodes, hours, chronic ones and the cities that have them, and the city with most hours."""
    by_city = found.groupBy("city_id").agg(F.count("*").alias("n"), F.sum("duration").alias("hours"), F.max("peak").alias("peak"), F.count_if("chronic").alias("chronic"))
    worst = F.max_by(F.struct("city_id", "hours", "n", "peak"), F.struct("hours", "peak"))
    return by_city.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("episodes"), F.coalesce(F.sum("hours"), F.lit(0)).alias("hours"), F.coalesce(F.sum("chronic"), F.lit(0)).alias("chronic"), F.count_if(F.col("chronic") > 0).alias("chronic_cities"), worst.alias("w")).select("episodes", "hours", "chronic", "chronic_cities", F.col("w.city_id").alias("worst_city"), F.col("w.hours").alias("worst_hours"), F.round("w.peak", 2).alias("worst_peak"))


def level_distribution(found: DataFrame) -> DataFrame:
    """Episodes by the level of their peak; every level is there."""
    counts = found.groupBy(F.col("peak_level").alias("level")).agg(F.count("*").alias("n"))
    levels = found.sparkSession.createDataFrame([(i, x) for i, x in enumerate(S.LEVELS)], "rank int, level string")
    return levels.join(counts, "level", "left").select("level", "rank", F.coalesce("n", F.lit(0)).alias("n")).orderBy("rank")
