"""Compliance, comparisons of periods, rankings and summaries over entity, date and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compliance(df: DataFrame, ceiling: float, level: Column, levels: list[str], target: float = 80.0) -> DataFrame:
    """Days, good days, their share, gap to the target and whether it is met, and days of every level (0 if none),
    by entity and over all (entity null), in one aggregate; with columns exceed_hours and obs_hours their sums and
    share as well."""
    good = F.col("value") <= ceiling
    d = df.where("value IS NOT NULL").withColumn("level", level)
    hours = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("exceed_hours", "obs_hours") if c in df.columns]
    out = d.groupingSets([["entity"], []], "entity").agg(F.count("*").alias("days"), F.count_if(good).alias("good_days"), F.count_if(~good).alias("exceed_days"), F.avg("value").alias("mean"), F.max("value").alias("peak"), *hours, *(F.count_if(F.col("level") == x).alias(f"days_{x}") for x in levels))
    out = out.withColumn("good_percent", 100.0 * F.try_divide("good_days", "days"))
    if len(hours) == 2:
        out = out.withColumn("exceed_hour_percent", 100.0 * F.try_divide(F.col("exceed_hours"), F.col("obs_hours")))
    return out.withColumns({"target": F.lit(target), "gap": F.col("good_percent") - target, "target_met": F.col("good_percent") >= target})


def compliance_totals(report: DataFrame) -> DataFrame:
    """One row over the entities of ``compliance``: how many, how many meet the target, the best and the worst."""
    d = report.where("entity IS NOT NULL")
    return d.agg(F.count("*").alias("entities"), F.count_if("target_met").alias("meeting_target"), F.min_by("entity", F.struct(-F.col("good_percent"), F.col("entity"))).alias("best"), F.min_by("entity", F.struct(F.col("good_percent"), F.col("entity"))).alias("worst"))


# Directions of a change where less is better.
BETTER, WORSE, SAME, UNKNOWN = "改善", "转差", "持平", "数据不足"


def _changes(d: DataFrame, now: Column, before: Column) -> DataFrame:
    """Means and days of two periods by entity, their difference, percentage and direction."""
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    d = d.groupBy("entity").agg(mean(now).alias("current"), mean(before).alias("previous"), F.count_if(now).alias("current_days"), F.count_if(before).alias("previous_days"))
    delta = F.col("current") - F.col("previous")
    trend = F.when(delta.isNull(), UNKNOWN).when(delta < 0, BETTER).when(delta > 0, WORSE).otherwise(SAME)
    return d.where("current_days > 0").withColumns({"delta": delta, "percent": 100.0 * F.try_divide(delta, F.abs("previous")), "trend": trend})


def period_change(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Means of the last ``days`` days to ``as_of`` and of as many before, in one pass."""
    end = F.lit(as_of).cast("date")
    age = F.date_diff(end, F.col("date"))
    return _changes(df.where(F.col("date").between(F.date_sub(end, 2 * days - 1), end)), age.between(0, days - 1), age.between(days, 2 * days - 1))


def year_period_change(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The last ``days`` days to ``as_of`` with the same period a year before (28 Feb for 29 Feb), in one pass."""
    end, date = F.lit(as_of).cast("date"), F.col("date")
    first = F.date_sub(end, days - 1)
    now, before = date.between(first, end), date.between(F.add_months(first, -12), F.add_months(end, -12))
    return _changes(df.where(now | before), now, before)


def year_change(df: DataFrame) -> DataFrame:
    """Each day's value with that of the same day a year before (28 Feb for 29 Feb)."""
    old = df.select("entity", F.col("date").alias("old_date"), F.col("value").alias("last_year"))
    d = df.withColumn("old_date", F.add_months("date", -12)).join(old, ["entity", "old_date"])
    return d.groupBy("entity").agg(F.count("*").alias("days"), F.avg("value").alias("this_year"), F.avg("last_year").alias("last_year"), F.avg(F.col("value") - F.col("last_year")).alias("change"))


def extremes(df: DataFrame) -> DataFrame:
    """Best (least) and worst day by entity, the first of equals."""
    return df.groupBy("entity").agg(F.min_by("date", F.struct("value", "date")).alias("best_day"), F.min("value").alias("best"), F.max_by("date", F.struct("value", -F.unix_date("date"))).alias("worst_day"), F.max("value").alias("worst"), F.avg("value").alias("mean"))


def rankings(df: DataFrame, metrics: dict[str, Column], limit: int = 10) -> DataFrame:
    """The first ``limit`` entities of each metric (a column to sort by, descending)."""
    long = df.select("entity", F.explode(F.array(*(F.struct(F.lit(k).alias("ranking"), c.cast("double").alias("score")) for k, c in metrics.items()))).alias("r")).select("entity", "r.*")
    w = Window.partitionBy("ranking").orderBy(F.desc("score"), "entity")
    return long.where("score IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
