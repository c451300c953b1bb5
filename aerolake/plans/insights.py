"""The analyses by name: what they are for, what they need, the bounds of their parameters, and how they run.

Each takes the hourly or the daily environment inside its window and returns one DataFrame. An unknown name or a
parameter out of its bounds is an error before anything is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import standards as S
from aerolake.operators import patterns, report, similar, stats
from aerolake.plans import episodes, read_model


@dataclass(frozen=True)
class Insight:
    """``bounds`` are the least and greatest values of whole or real parameters, ``days`` the window by default."""

    key: str
    name: str
    category: str
    needs: str  # hourly or daily
    run: Callable[..., DataFrame]
    days: int = 30
    bounds: tuple[tuple[str, float, float], ...] = (("days", 1, 365),)


def _series(df: DataFrame, metric: str, time: str = "time") -> DataFrame:
    return df.select(F.col("city_id").alias("entity"), F.col(time).alias("time"), F.col(metric).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")


def _days(df: DataFrame, metric: str) -> DataFrame:
    return _series(df, metric, "date").withColumnRenamed("time", "date")


def distribution(df, metrics=("european_aqi", "pm2_5"), **_):
    return stats.distribution(df, list(metrics), "city_id")


def correlation(df, metrics=("pm2_5", "pm10"), **_):
    d = stats.correlation_matrix(df, list(metrics))
    return d.withColumn("strength", S.correlation_label(F.col("pearson"))).orderBy(F.abs("pearson").desc_nulls_last(), "left", "right").limit(12)


def hourly_profile(df, metric="european_aqi", **_):
    return patterns.hour_profile(_series(df, metric))


def weekly_profile(df, metric="aqi_avg", **_):
    return patterns.weekday_contrast(_series(df, metric, "date"))


def monthly_trend(df, metric="aqi_avg", **_):
    return patterns.monthly(_series(df, metric, "date"))


def outliers(df, metric="european_aqi", threshold=3.0, method="zscore", **_):
    d = df.select("city_id", "time", F.col(metric).alias("value"))
    return stats.fence_outliers(d, "value", ["city_id"], threshold) if method == "iqr" else stats.outlier_report(d, "value", ["city_id"], threshold)


def found_episodes(df, threshold=100.0, gap=3, shortest=2, limit=30, value="china_aqi", **_):
    return episodes.ranked(episodes.episodes(df, value, threshold, gap, shortest), limit)


def relationship(df, x="wind_speed_10m", y="pm2_5", bins=10, **_):
    return stats.relationship_report(df, x, y, "city_id", bins)


def compliance(df, ceiling=100.0, target=80.0, metric="china_aqi", **_):
    d = _days(df, metric).join(df.select(F.col("city_id").alias("entity"), "date", "exceed_hours", "obs_hours"), ["entity", "date"])
    return report.compliance(d, ceiling, S.china_aqi_level(F.col("value")), S.LEVELS, target)


def comparison(df, as_of, days=30, metric="china_aqi", **_):
    return report.period_change(_days(df, metric), str(as_of)[:10], days)


def clustering(df, features=("pm2_5", "temperature_2m"), k=None, restarts=10, **_):
    names = list(features)
    means = stats.imputed(df.groupBy(F.col("city_id").alias("entity")).agg(*(F.avg(c).alias(c) for c in names)), names)
    vectors = stats.standardised(means, names).select("entity", F.array(*names).alias("v"))
    k = k or similar.choose_k(vectors, restarts=restarts).where("best").first()["k"]
    return similar.cluster_report(vectors, similar.cluster(vectors, k, restarts), names)


# Keys, names and categories of the analyses, and the bounds of their parameters.
INSIGHTS = [
    Insight("distribution", "统计与分布", "描述性分析", "hourly", distribution, bounds=(("days", 1, 365), ("bins", 5, 60))),
    Insight("correlation", "指标相关性", "描述性分析", "hourly", correlation),
    Insight("hourly-profile", "日内规律画像", "时段规律", "hourly", hourly_profile),
    Insight("weekly-profile", "周内规律画像", "时段规律", "daily", weekly_profile, 90, (("days", 7, 365),)),
    Insight("monthly-trend", "月度趋势", "时段规律", "daily", monthly_trend, 92, (("days", 28, 400),)),
    Insight("outliers", "异常点检测", "异常与过程", "hourly", outliers, bounds=(("days", 1, 365), ("threshold", 1, 10))),
    Insight("episodes", "污染过程识别", "异常与过程", "hourly", found_episodes, 92, (("days", 1, 400), ("gap", 0, 24), ("shortest", 1, 48), ("limit", 1, 200))),
    Insight("relationship", "气象—空气质量关系", "归因分析", "hourly", relationship, bounds=(("days", 1, 365), ("bins", 3, 20))),
    Insight("compliance", "达标考核", "考核与报表", "daily", compliance, 90, (("days", 7, 400), ("target", 0, 100))),
    Insight("comparison", "环比与同比", "考核与报表", "daily", comparison, 30, (("days", 7, 180),)),
    Insight("clustering", "城市聚类与相似度", "横向对比", "hourly", clustering, bounds=(("days", 1, 365), ("k", 2, 8))),
]


def catalog(spark: SparkSession) -> DataFrame:
    """place, key, name, category and what each analysis needs."""
    return spark.createDataFrame([(i, x.key, x.name, x.category, x.needs) for i, x in enumerate(INSIGHTS)], "place int, key string, name string, category string, needs string")


def run(key: str, tables: dict[str, DataFrame], cities: DataFrame, as_of, only: list[str] | None = None, **params) -> DataFrame:
    """An analysis over its window of tables["hourly"] or tables["daily"]; a comparison reads twice its days."""
    x = next((x for x in INSIGHTS if x.key == key), None)
    if x is None:
        raise ValueError(f"no analysis {key}: {[x.key for x in INSIGHTS]}")
    days = params.setdefault("days", x.days)
    for name, lo, hi in x.bounds:
        if params.get(name) is not None and not lo <= params[name] <= hi:
            raise ValueError(f"{name} must be from {lo} to {hi}")
    back = 2 * days + 2 if key == "comparison" else days
    return x.run(read_model.window(tables[x.needs], cities, as_of, back, x.needs, only), as_of=as_of, **params)


def digest(tables: dict[str, DataFrame], cities: DataFrame, as_of, days: int = 30, value: str = "china_aqi") -> DataFrame:
    """One row for the first page: share of good days, best and worst city, episodes, and the city with the widest
    day. At least 30 days are looked at."""
    days = max(days, 30)
    c = run("compliance", tables, cities, as_of, days=days, metric=value)
    total = c.where("entity IS NULL").select("good_percent", F.col("mean").alias("aqi_avg"), "days")
    ends = report.compliance_totals(c).select(F.col("best").alias("best_city"), F.col("worst").alias("worst_city"), "meeting_target")
    found = episodes.totals(episodes.episodes(read_model.window(tables["hourly"], cities, as_of, days), value))
    wide = run("hourly-profile", tables, cities, as_of, days=days, metric=value).where("entity IS NOT NULL").agg(F.min_by("entity", F.struct(-F.col("amplitude"), F.col("entity"))).alias("most_volatile"))
    return total.crossJoin(ends).crossJoin(found.select("episodes", "hours", "chronic")).crossJoin(wide)  # a row each
