"""Jobs: collection with the failures of a city kept to itself, and pipelines in the order of their needs.

What is wrong with a city is a row of the outcome, not an exception; what is wrong with a job is a row of the runs,
and jobs that need it are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.operators import joins
from aerolake.plans import derive, summary
from aerolake.sources import endpoints, lake

# The stages of each scope.
SCOPES = {"all": ("reference", "collect", "derive"), "reference": ("reference",), "collect": ("reference", "collect"), "derive": ("derive",), "status_only": ()}


def forecast_flag(time: Column, local_now: Column) -> Column:
    """1 for times after the city's own now, to the minute, compared as texts as they are written."""
    return F.coalesce((time.cast("string") > F.date_format(local_now, "yyyy-MM-dd'T'HH:mm")).cast("int"), F.lit(0))


def collected(answers: DataFrame, cities: DataFrame, variables: dict[str, str], endpoint: str) -> tuple[DataFrame, DataFrame]:
    """Rows and outcomes of answers (city_id, body, error). rows: city_id, time, the variables and is_forecast by the
    local_now of cities (city_id, local_now). outcomes: city_id, rows, missing variables, status and error: an answer
    that failed, can't be read or lacks every variable fails its own city."""
    good = answers.where("error IS NULL")
    lacks = endpoints.missing(good, endpoint)
    usable = good.join(lacks.where("NOT broken").select("city_id"), "city_id", "left_semi")
    rows = lake.rows_of(usable.select("city_id", "body"), variables).join(cities.select("city_id", "local_now"), "city_id", "left")
    rows = rows.withColumn("is_forecast", forecast_flag(F.col("time"), F.col("local_now"))).drop("local_now")
    counts = rows.groupBy("city_id").agg(F.count("*").alias("rows"))
    d = answers.select("city_id", "error").join(lacks, "city_id", "left").join(counts, "city_id", "left")
    error = F.coalesce("error", F.when(F.col("broken"), "the answer has none of the variables"))
    outcomes = d.select("city_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.when(error.isNotNull(), summary.FAILED).otherwise(summary.SUCCESS).alias("status"), error.alias("error"))
    return rows, outcomes


def outcome(outcomes: DataFrame) -> DataFrame:
    """One row for a job: cities, failed ones, rows and status; nothing from any city counts as skipped."""
    d = outcomes.agg(F.count("*").alias("cities"), F.count_if(F.col("status") == summary.FAILED).alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return d.withColumn("status", summary.job_status(F.col("cities"), F.col("failed"), F.col("rows")))


def located(cities: DataFrame, answers: DataFrame, most_km: float = 100.0) -> DataFrame:
    """cities with the nearest of their own candidates (geocoding answers) and its distance; ``far`` if none lies
    within most_km."""
    c = endpoints.places(answers)
    d = cities.select("city_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).join(c, "city_id", "left")
    km = joins.haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    best = d.withColumn("km", F.round(km, 2)).groupBy("city_id").agg(F.min_by(F.struct("name", "latitude", "longitude", "country", "admin1", "timezone", "population"), F.when(F.col("km").isNotNull(), F.struct("km", "place"))).alias("b"), F.min("km").alias("km"))
    return best.select("city_id", "b.*", "km", F.coalesce(F.col("km") >= most_km, F.lit(True)).alias("far"))


#: Hours before the first derived one whose values its means take in.
LEAD_HOURS = 23


def _earlier(start: str | None, hours: int) -> str | None:
    return None if start is None else (datetime.fromisoformat(start) - timedelta(hours=hours)).isoformat()


def derive_hourly(spark: SparkSession, root: str, forecast: lake.Asset, archive: lake.Asset, air: lake.Asset, target: lake.Asset, cities: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """From the lake to the lake: weather and air quality of a window fused, with indices and measures, merged into ``target``. The report of the
    upsert is returned. Hours before the window are read for the means and not written. Without any source row nothing is."""
    some = lambda a: lake.scan(spark, root, a, cities, _earlier(start, LEAD_HOURS), end)
    d = derive.hourly(derive.fused(some(forecast), some(archive), some(air)))
    d = d.where(F.col("time") >= F.lit(start).cast("timestamp_ntz")) if start else d
    return lake.upsert(d, root, target)


def derive_daily(spark: SparkSession, root: str, hourly: lake.Asset, target: lake.Asset, cities: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """From the hourly table of the lake to the daily one, whole days only: the window begins and ends with its days.
    The report of the upsert is returned."""
    d = lake.scan(spark, root, hourly, cities, _earlier(start and start[:10], LEAD_HOURS), end and f"{end[:10]}T23:59:59")
    d = derive.daily(d)
    d = d.where(F.col("date") >= F.lit(start[:10]).cast("date")) if start else d
    return lake.upsert(d, root, target)


@dataclass(frozen=True)
class Job:
    """run() does the work and returns the number of rows written; ``needs`` names jobs that come first."""

    name: str
    stage: str
    run: Callable[[], int]
    needs: tuple[str, ...] = ()


def ordered(jobs: list[Job], scope: str = "all") -> list[Job]:
    """The jobs of a scope, each after those it needs; a circle is an error."""
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope}: {sorted(SCOPES)}")
    left, done, out = [j for j in jobs if j.stage in SCOPES[scope]], set(), []
    names = {j.name for j in left}
    while left:
        ready = [j for j in left if set(j.needs) & names <= done]
        if not ready:
            raise ValueError(f"jobs in a circle: {[j.name for j in left]}")
        out += ready
        done |= {j.name for j in ready}
        left = [j for j in left if j.name not in done]
    return out


def run_pipeline(spark: SparkSession, jobs: list[Job], run_id: str, now, scope: str = "all", trigger: str = "manual") -> DataFrame:
    """Run the jobs of a scope in order and return their runs (as the catalog keeps them); a job that fails makes
    those that need it skipped, and no other."""
    rows, bad = [], set()
    for job in ordered(jobs, scope):
        written, error, status = 0, None, summary.SUCCESS
        if set(job.needs) & bad:
            status, error = summary.SKIPPED, "a job that it needs failed"
        else:
            try:
                written = job.run()
            except (PySparkException, ValueError, OSError) as e:
                status, error = summary.FAILED, str(e).splitlines()[0][:300]
        if status != summary.SUCCESS:
            bad.add(job.name)
        rows.append((run_id, job.name, status, trigger, written, error))
    d = spark.createDataFrame(rows, "run_id string, job string, status string, trigger string, rows_written bigint, error string")
    return d.withColumn("started_at", F.lit(str(now)).cast("timestamp_ntz"))
