"""Summaries of what runs, checks and assets left behind; each is one grouped aggregate.

Empty inputs give empty summaries; a null key is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators import patterns

SUCCESS, PARTIAL, FAILED, SKIPPED = "success", "partial", "failed", "skipped"


def job_status(units: Column, failed: Column, rows: Column | None = None) -> Column:
    """The status of a job from its number of units, of failed units and, where a job that got
    nothing counts as skipped, of rows received."""
    idle = F.lit(False) if rows is None else rows == 0
    return F.when(units == 0, SKIPPED).when(failed == units, FAILED).when(failed > 0, PARTIAL).when(idle, SKIPPED).otherwise(SUCCESS)


def pipeline_status(status: str = "status") -> Column:
    """The status of a group of jobs (an aggregate)."""
    every, some = (lambda s: F.every(F.col(status) == s)), (lambda *s: F.some(F.col(status).isin(*s)))
    return F.when(F.count("*") == 0, SKIPPED).when(every(FAILED), FAILED).when(some(FAILED, PARTIAL), PARTIAL).when(every(SKIPPED), SKIPPED).otherwise(SUCCESS)


def runs(df: DataFrame, since: Column, sums: list[str]) -> DataFrame:
    """Runs (job, status, started_at) from ``since`` on, for each job and, where ``overall``, for
    all: their number by status, the share of successes in percent, the last start, and sums."""
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in (SUCCESS, PARTIAL, FAILED)]
    share = F.round(100.0 * F.count_if(F.col("status") == SUCCESS) / F.count("*"), 1).alias("success_rate")
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in sums]
    d = df.where(F.col("started_at") >= since).rollup("job")
    return d.agg((F.grouping("job") == 1).alias("overall"), F.count("*").alias("total"), *by_status, share, F.max("started_at").alias("last_run_at"), *totals)


def latest_scores(scores: DataFrame, order: list[Column]) -> DataFrame:
    """The newest score of each asset."""
    return patterns.latest(scores, order, ["asset"])


def platform_quality(latest: DataFrame, dimensions: list[str]) -> DataFrame:
    """For each grade and, where ``overall``, for all assets: their number, mean score and means of
    the dimensions."""
    means = [F.round(F.avg(c), 2).alias(c) for c in ("overall_score", *dimensions)]
    return latest.rollup("grade").agg((F.grouping("grade") == 1).alias("overall"), F.count("*").alias("assets"), *means)


def worst(latest: DataFrame, n: int = 5) -> DataFrame:
    """The n assets of the lowest score; ties go by asset."""
    return latest.orderBy(F.asc_nulls_last("overall_score"), "asset").limit(n)


def top_failing(results: DataFrame, n: int = 8) -> DataFrame:
    """The n checks that fail or warn most often; ties go by name."""
    bad = results.where(F.col("status").isin("failed", "warning"))
    counts = bad.groupBy("check", "dimension").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "warning").alias("n_warning"))
    return counts.orderBy(F.desc("n"), "check", "dimension").limit(n)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value and n: how often each value of each column occurs."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def partition_sizes(lake: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """Partitions, files and bytes for each value of ``by``, a partition column; only the files'
    footers are read. Files without a row don't count."""
    files = lake.select(by, *(p for p in parts if p != by), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.groupBy(by).agg(F.count_distinct(F.struct(*parts)).alias("partitions"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
