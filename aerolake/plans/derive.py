"""Derivation jobs: hourly fusion with indices, and the daily roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import standards as S
from aerolake.operators.joins import fuse
from aerolake.operators.patterns import trailing_means

GASES = ["nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"]


def _indices(pm25, pm10, ozone) -> dict:
    return {"pm2_5": pm25, "pm10": pm10, "ozone": ozone} | {g: F.col(g) for g in GASES}


def fused(forecast: DataFrame, archive: DataFrame, air: DataFrame) -> DataFrame:
    """Forecast over archive, then weather over air quality, all by full outer join on city_id, time."""
    weather = fuse(forecast, archive, ["city_id", "time"]).withColumn("is_forecast", F.coalesce("is_forecast", F.lit(0)))
    return fuse(weather, air, ["city_id", "time"])


def hourly(df: DataFrame) -> DataFrame:
    """Indices, levels and weather measures of every hour; particles as means of 24 rows, ozone of 8. The
    largest sub-index and load are columns of a projection of their own, so that each is computed once."""
    d = trailing_means(S.compilable(df), {"_pm25": ("pm2_5", 24), "_pm10": ("pm10", 24), "_o3": ("ozone", 8)}, "city_id")
    d = d.withColumns({"_iaqi": S.best_iaqi(_indices(F.col("_pm25"), F.col("_pm10"), F.col("_o3"))), "_load": S.best_load({k: F.col(k) for k in S.LOAD_POINTS})})
    china = S.china_of(F.col("_iaqi"), list(S.IAQI_POINTS))
    d = d.withColumns({
        "china_aqi": china["aqi"], "china_aqi_level": china["level"], "china_primary_pollutant": china["primary"],
        "aqi_level": S.aqi_level(F.col("european_aqi")), "primary_pollutant": S.primary_of(F.col("_load"), list(S.LOAD_POINTS)),
        "comfort_index": S.comfort_index(F.col("temperature_2m"), F.col("relative_humidity_2m"), F.col("wind_speed_10m")),
        "ventilation_index": S.ventilation_index(F.col("wind_speed_10m")), "is_stagnant": S.is_stagnant(F.col("wind_speed_10m"), F.col("precipitation")),
    })
    return d.drop("_pm25", "_pm10", "_o3", "_iaqi", "_load")


def daily(df: DataFrame, good: float = 100.0, exceed: float = 100.0) -> DataFrame:
    """One row for each city and day. Sums of nothing are 0."""
    d = trailing_means(df, {"o8": ("ozone", 8)}, "city_id").withColumn("date", F.to_date("time"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = d.groupBy("city_id", "date").agg(
        F.avg("temperature_2m").alias("temp_avg"), F.max("temperature_2m").alias("temp_max"), F.min("temperature_2m").alias("temp_min"), F.avg("relative_humidity_2m").alias("humidity_avg"),
        zero(F.sum("precipitation")).alias("precipitation_sum"), F.avg("wind_speed_10m").alias("wind_speed_avg"), F.avg("european_aqi").alias("aqi_avg"), F.max("european_aqi").alias("aqi_max"),
        F.avg("pm2_5").alias("pm2_5"), F.avg("pm10").alias("pm10"), F.max("o8").alias("ozone"), *(F.avg(g).alias(g) for g in GASES),
        F.count_if(F.col("china_aqi") > exceed).alias("exceed_hours"), zero(F.sum("is_stagnant")).alias("stagnant_hours"), F.count("*").alias("obs_hours"),
    )
    out = out.withColumn("_iaqi", S.best_iaqi(_indices(F.col("pm2_5"), F.col("pm10"), F.col("ozone"))))
    china = S.china_of(F.col("_iaqi"), list(S.IAQI_POINTS))
    out = out.withColumns({"china_aqi": china["aqi"], "china_aqi_level": china["level"], "china_primary_pollutant": china["primary"], "dominant_aqi_level": S.aqi_level(F.col("aqi_max"))})
    return out.withColumn("good_air_day", (F.col("china_aqi") <= good).cast("int")).drop("_iaqi")
