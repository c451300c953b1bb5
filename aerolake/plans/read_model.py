"""What boards read: current conditions, series, alerts, cities, metrics, availability and windows.

Tables are the hourly and daily environment (city_id and time or date first) and the cities (city_id, name, timezone,
active and what else there is). What depends on the clock takes ``now`` or ``as_of``, a time without zone. Empty
inputs give empty results; a city without attributes keeps its rows.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import standards as S
from aerolake.functions.scalars import short_label
from aerolake.operators import patterns, report
from aerolake.sources import query

# Days that analyses look back, and days that the archive lags behind.
HOURLY_DAYS, DAILY_DAYS, ARCHIVE_DAYS, AIR_DAYS, ARCHIVE_LAG = 30, 90, 180, 92, 6
# Kinds of data.
FORECAST, OBSERVED = "预报", "实况"
DEFAULT_METRICS = ["temperature_2m", "european_aqi", "pm2_5", "pm10"]


def city_index(cities: DataFrame, now_utc: Column) -> DataFrame:
    """The active cities with ``local_now``; a zone that doesn't exist counts as UTC."""
    zone = F.when(F.col("timezone").isin(sorted(available_timezones())), F.col("timezone")).otherwise("UTC")
    return cities.where("active").withColumn("local_now", F.convert_timezone(F.lit("UTC"), zone, now_utc)).orderBy("city_id")


def current(hourly: DataFrame, cities: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The newest observed row of each city, or its newest forecast if it has no other, with the city's
    attributes, labels and alerts; the worst index first, none as 0."""
    if only:
        hourly = hourly.where(F.col("city_id").isin(only))
    d = patterns.latest(hourly, [F.col("is_forecast").asc_nulls_last(), F.col("time").desc_nulls_last()], ["city_id"])
    d = d.join(cities, "city_id", "left")  # Spark broadcasts cities while they are small
    aqi, forecast = F.col("european_aqi"), F.coalesce("is_forecast", F.lit(0)) > 0
    d = d.withColumn("aqi_level", S.aqi_level(aqi))
    d = d.withColumns({
        "city_name": F.coalesce("name", "city_id"), "weather_label": S.weather_label(F.col("weather_code")), "aqi_color": S.aqi_color(aqi),
        "health_advice": S.advice(F.col("aqi_level")), "data_kind": F.when(forecast, FORECAST).otherwise(OBSERVED),
        "alerts": S.alerts({m: F.col(m) for _, m, *_ in S.ALERTS if m in hourly.columns}),
    })
    return d.orderBy(F.coalesce(S.clean(aqi), F.lit(0.0)).desc(), "city_id")


def hourly_series(hourly: DataFrame, city: str, now, hours: int = 72, metrics: list[str] | None = None) -> DataFrame:
    """Rows of a city from ``hours`` before to as many after ``now``, in order of time."""
    chosen = query.known_metrics(metrics) or DEFAULT_METRICS
    span, t = F.expr(f"INTERVAL {int(hours)} HOUR"), F.lit(str(now)).cast("timestamp_ntz")
    columns = ["time", "is_forecast", "weather_code", *(m for m in dict.fromkeys(chosen) if m != "weather_code")]
    return hourly.where((F.col("city_id") == city) & F.col("time").between(t - span, t + span)).select(*columns).orderBy("time")


def forecast_boundary(series: DataFrame, entity: str = "city_id") -> DataFrame:
    """First forecast time of each city; null where all or none are forecasts."""
    return patterns.boundary(series.withColumn("entity", F.col(entity)), "is_forecast")


def daily_series(daily: DataFrame, city: str, today, days: int = 30) -> DataFrame:
    """Days of a city up to ``today`` and back, with the level of each day's peak."""
    end = F.lit(str(today)).cast("date")
    d = daily.where((F.col("city_id") == city) & F.col("date").between(F.date_sub(end, int(days)), end))
    return d.withColumn("aqi_level", S.aqi_level(F.col("aqi_max"))).orderBy("date")


def daily_summary(daily: DataFrame) -> DataFrame:
    """One row a city: days, means, totals, share of good days, best and worst day with their levels."""
    first = report.extremes(daily.select(F.col("city_id").alias("entity"), "date", F.col("aqi_avg").alias("value")).where("value IS NOT NULL"))
    d = daily.groupBy("city_id").agg(
        F.count("*").alias("days"), F.avg("aqi_avg").alias("aqi_avg"), F.max("aqi_avg").alias("aqi_max"), F.avg("temp_avg").alias("temp_avg"), F.sum("precipitation_sum").alias("precipitation_total"),
        F.sum("exceed_hours").cast("bigint").alias("exceed_hours_total"), F.sum(F.coalesce("good_air_day", F.lit(0))).cast("bigint").alias("good_air_days"),
    )
    d = d.withColumn("good_air_rate", F.round(S.safe_ratio(F.col("good_air_days"), F.col("days")) * 100, 1))
    ends = first.select(F.col("entity").alias("city_id"), "best_day", F.col("best").alias("best_aqi"), S.aqi_level(F.col("best")).alias("best_level"), "worst_day", F.col("worst").alias("worst_aqi"), S.aqi_level(F.col("worst")).alias("worst_level"))
    return d.join(ends, "city_id", "left")


def alert_list(conditions: DataFrame) -> DataFrame:
    """One row an alert of ``current``, the gravest first, then by city."""
    rank = F.array_position(F.lit(S.SEVERITIES), F.col("severity"))
    return conditions.select("city_id", "city_name", F.col("time").alias("observed_at"), F.explode("alerts").alias("a")).select("city_id", "city_name", "observed_at", "a.*").orderBy(rank, "city_name", "metric")


def alert_counts(conditions: DataFrame) -> DataFrame:
    """severity and n, and cities monitored in each row."""
    n = conditions.select("city_id").distinct().agg(F.count("*").alias("cities_monitored"))
    return alert_list(conditions).groupBy("severity").agg(F.count("*").alias("n")).join(F.broadcast(n))  # one row


def city_rankings(conditions: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` cities by worst air, best air, heat and rain."""
    d = conditions.withColumn("entity", F.col("city_id"))
    aqi = F.col("european_aqi")
    return report.rankings(d, {"worst_air": aqi, "best_air": -aqi, "hottest": F.col("temperature_2m"), "wettest": F.col("precipitation")}, limit)


def compared(hourly: DataFrame, only: list[str], metric: str, now, hours: int = 168, unit: str = "hour") -> DataFrame:
    """Means of a metric by city and hour or day over the last hours."""
    if metric not in query.NUMERIC_METRICS:
        metric = "european_aqi"
    start = F.lit(str(now)).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOUR")
    d = hourly.where(F.col("city_id").isin(only) & (F.col("time") >= start)).select(F.col("city_id").alias("entity"), "time", F.col(metric).alias("value"))
    return patterns.bucketed(d, unit)


def metric_catalog(columns: DataFrame) -> DataFrame:
    """columns (name, type, unit, description) of the hourly table with label and what they are good for."""
    return columns.where("name NOT IN ('city_id', 'time', 'ingested_at', 'source_run_id')").select(
        "name", short_label(F.coalesce("description", F.lit("")), F.col("name")).alias("label"), "description", "unit", "type",
        F.col("type").isin("double", "integer").alias("numeric"), F.col("name").isin(query.CORE_METRICS).alias("core"), F.col("name").isin(query.NUMERIC_METRICS).alias("comparable"),
    )


def availability(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Each active asset (asset_key, status) with the cities that have files (asset_key, city)."""
    held = files.groupBy("asset_key").agg(F.array_sort(F.collect_set("city")).alias("cities"))  # a city once for each asset
    d = assets.where("status = 'active'").join(held, "asset_key", "left")
    return d.withColumns({"cities": F.coalesce("cities", F.array().cast("array<string>")), "available": F.col("cities").isNotNull()})


def _cities_of(df: DataFrame, cities: DataFrame, only: list[str] | None) -> DataFrame:
    return df.join(query.resolve(cities, only).select("city_id"), "city_id", "left_semi")


def window(df: DataFrame, cities: DataFrame, as_of, days: int, kind: str = "hourly", only: list[str] | None = None, columns: list[str] | None = None, require: list[str] | None = None) -> DataFrame:
    """Rows that analyses use: of the chosen active cities, back from ``as_of``, with values in the required
    columns. hourly and air: the last days, forecasts too; daily: days up to as_of; archive: whole days up to
    ARCHIVE_LAG days before it."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    if kind == "daily":
        end = F.to_date(now)
        df = df.where(F.col("date").between(F.date_sub(end, days), end))
    elif kind == "archive":
        end = F.date_sub(F.to_date(now), ARCHIVE_LAG)
        df = df.where((F.col("time") >= F.date_sub(end, days).cast("timestamp_ntz")) & (F.col("time") < F.date_add(end, 1).cast("timestamp_ntz")))
    else:
        df = df.where(F.col("time") >= now - F.expr(f"INTERVAL {int(days)} DAY"))
    return query.required(query.fetch(_cities_of(df, cities, only), columns), require or [])
