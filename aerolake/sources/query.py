"""Reading: validated projections and bounds, latest rows, samples, counts and schemas.

Empty inputs give empty results of the same schema. Names are checked against the columns before they reach a plan,
and values are literals, so no text of a caller becomes SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.standards import clean

# Metrics of the hourly table that boards show, and those that can be compared.
CORE_METRICS = "temperature_2m apparent_temperature relative_humidity_2m precipitation wind_speed_10m pressure_msl pm2_5 pm10 ozone nitrogen_dioxide sulphur_dioxide carbon_monoxide european_aqi us_aqi aqi_level primary_pollutant comfort_index ventilation_index is_stagnant".split()
NUMERIC_METRICS = "temperature_2m apparent_temperature relative_humidity_2m precipitation wind_speed_10m pressure_msl cloud_cover pm2_5 pm10 ozone nitrogen_dioxide sulphur_dioxide carbon_monoxide european_aqi us_aqi comfort_index ventilation_index".split()
# Columns of the daily table that stand for an hourly metric, and the hourly metric of a daily column.
DAILY_COLUMNS = {"european_aqi": ["aqi_avg", "aqi_max"], "temperature_2m": ["temp_avg", "temp_max", "temp_min"], "relative_humidity_2m": ["humidity_avg"], "precipitation": ["precipitation_sum"], "wind_speed_10m": ["wind_speed_avg"], "pressure_msl": ["pressure_avg"], "pm2_5": ["pm2_5_avg"], "pm10": ["pm10_avg"]}
HOURLY_OF = {daily: hourly for hourly, columns in DAILY_COLUMNS.items() for daily in columns}
TIME_COLUMNS = ("time", "date")


def identifier(name: str) -> str:
    """The name itself, if it is letters, digits and underscores and doesn't begin with a digit."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def time_column(df: DataFrame, asked: str | None = None) -> str | None:
    """The column asked for if there is one, else the first of TIME_COLUMNS that there is."""
    return next((c for c in (asked, *TIME_COLUMNS) if c in df.columns), None)


def schema(df: DataFrame) -> DataFrame:
    """place, name, type and nullable of every column."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string, nullable boolean")


def row_count(df: DataFrame) -> DataFrame:
    """One row: n."""
    return df.agg(F.count("*").alias("n"))


def fetch(df: DataFrame, columns: list[str] | None = None, start=None, end=None, where: Column | None = None, entities: Iterable[str] | None = None, entity: str = "city_id", time: str | None = None, order_by: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows between two inclusive bounds of the time column, of some entities, that keep a rule; columns
    that don't exist are an error, bounds on a table without a time column have no effect. Ordered rows of
    equal times have no order among themselves unless ``order_by`` names more columns, by commas."""
    if unknown := [c for c in map(identifier, columns or []) if c not in df.columns]:
        raise ValueError(f"no such columns: {unknown}")
    t = time_column(df, time)
    if t:
        kind = dict(df.dtypes)[t]
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                df = df.where(getattr(F.col(t), op)(F.lit(bound if isinstance(bound, str) else bound.isoformat()).cast(kind)))
    if entities is not None:
        df = df.where(F.col(entity).isin(list(entities)))
    if where is not None:
        df = df.where(where)
    if order_by:
        first, *rest = [identifier(c.strip()) for c in order_by.split(",")]
        df = df.orderBy(F.col(first).desc_nulls_last() if descending else F.col(first).asc_nulls_last(), *rest)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def latest_rows(df: DataFrame, n: int, time: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """The last n rows by time, the newest first."""
    return df.orderBy(F.col(time_column(df, time)).desc_nulls_last(), *(ties or [])).limit(n)


def sample(df: DataFrame, n: int = 20, time: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """The last n rows by time, the oldest first; without a time column any n rows."""
    t = time_column(df, time)
    return latest_rows(df, n, t, ties).orderBy(F.col(t).asc_nulls_last(), *(ties or [])) if t else df.limit(n)


FUNCTIONS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "stddev": F.stddev_samp}


def aggregate(df: DataFrame, by: str, measures: dict[str, list[str]]) -> DataFrame:
    """Functions of columns by one key, named function_column, in the order of the key; only FUNCTIONS are allowed."""
    if unknown := {f for fs in measures.values() for f in fs} - FUNCTIONS.keys():
        raise ValueError(f"no such functions: {sorted(unknown)}")
    aggs = [FUNCTIONS[f](identifier(c)).alias(f"{f}_{c}") for c, fs in measures.items() for f in fs]
    return df.groupBy(identifier(by)).agg(*aggs).orderBy(by)


def known_metrics(asked: Iterable[str] | None) -> list[str]:
    """Those asked for that boards may show, in the order asked."""
    allowed = {*CORE_METRICS, *NUMERIC_METRICS, "weather_code"}
    return [m for m in asked or [] if m in allowed]


def daily_column(columns: list[str], metric: str) -> str | None:
    """The column of a daily table that holds an hourly metric: of the same name, by DAILY_COLUMNS, or
    with a suffix."""
    tried = [metric, *DAILY_COLUMNS.get(metric, []), *(metric + s for s in ("_avg", "_sum", "_max"))]
    return next((c for c in tried if c in columns), None)


def resolve(cities: DataFrame, asked: list[str] | None, strict: bool = False) -> DataFrame:
    """The active cities (city_id, active), or those asked for; unknown ones are ignored, or an error."""
    active = cities.where("active")
    if not asked:
        return active
    found = active.where(F.col("city_id").isin(asked))
    if strict and (unknown := set(asked) - {r["city_id"] for r in found.select("city_id").distinct().collect()}):  # no more than were asked for
        raise ValueError(f"no such cities: {sorted(unknown)}")
    return found


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a time and with a value in each of these columns that there is; times that are text are
    read as times, what can't be read goes."""
    for t in (c for c in TIME_COLUMNS if c in df.columns):
        if dict(df.dtypes)[t] == "string":
            df = df.withColumn(t, F.col(t).try_cast("date" if t == "date" else "timestamp_ntz"))
        df = df.where(F.col(t).isNotNull())
    for c in (c for c in columns if c in df.columns):
        df = df.where((clean(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)).isNotNull())
    return df


def sql(spark: SparkSession, text: str, frames: dict[str, DataFrame] | None = None, **values) -> DataFrame:
    """A query over the named frames, with {name} for a frame and :name for a value; values never become SQL."""
    return spark.sql(text, args=values, **(frames or {}))


def scalar(df: DataFrame):
    """The first value of the first row; None without rows."""
    row = df.first()
    return row[0] if row else None


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of some columns, in order."""
    return df.select(*map(identifier, columns)).distinct().orderBy(*columns)
