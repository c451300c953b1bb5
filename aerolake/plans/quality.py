"""Data quality: checks are expressions, all of a table run in one aggregate, then scores roll up.

A check is skipped (null score) where it has nothing to judge: an empty table, or no known values. Rates of bad
values become scores on a line: 100 up to the ``warn`` rate, 0 from the ``fail`` rate on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import standards as S

PASS, WARN = 90.0, 70.0
# Weights of severities and bounds of grades.
SEVERITY = {"critical": 3, "major": 2, "minor": 1}
GRADES = [(95.0, "A"), (85.0, "B"), (75.0, "C"), (60.0, "D")]
# Rates of bad values that cost the first and the last point.
OUTLIERS, INCONSISTENT, DUPLICATES = (0.01, 0.05), (0.02, 0.10), (0.001, 0.01)
#: Pairs of a day's least and greatest value, by the names of raw and served tables.
EXTREMES = [("temperature_2m_min", "temperature_2m_max"), ("apparent_temperature_min", "apparent_temperature_max"), ("temp_min", "temp_max")]


@dataclass(frozen=True)
class Check:
    """``score`` is an aggregate between 0 and 100; null: the check is skipped."""

    name: str
    dimension: str
    score: Column
    severity: str = "major"


def _share(bad: Column, of: Column) -> Column:
    return 100.0 * (1 - F.try_divide(bad, of))


def _graded(bad: Column, of: Column, rates: tuple[float, float]) -> Column:
    """The score of a rate of bad values."""
    return S.linear_score(1 - F.try_divide(bad, of), 1 - rates[0], 1 - rates[1])


def null_rate(columns: list[str]) -> Column:
    return sum((_share(F.count_if(F.col(c).isNull()), F.count("*")) for c in columns), F.lit(0.0)) / len(columns)


def in_range(column: str, low: float, high: float) -> Column:
    return _share(F.count_if(~F.col(column).between(low, high)), F.count(column))


def ranges(limits: dict[str, tuple[float, float]], rates: tuple[float, float] = OUTLIERS) -> Column:
    """Values of all ranged columns outside their ranges, on the line."""
    bad = sum((F.count_if(~F.col(c).between(lo, hi)) for c, (lo, hi) in limits.items()), F.lit(0))
    return _graded(bad, sum((F.count(c) for c in limits), F.lit(0)), rates)


def in_set(column: str, values: list) -> Column:
    return _share(F.count_if(~F.col(column).isin(values)), F.count(column))


def unique(keys: list[str]) -> Column:
    return 100.0 * F.try_divide(F.count_distinct(F.struct(*keys)), F.count("*"))


def no_duplicates(keys: list[str], rates: tuple[float, float] = DUPLICATES) -> Column:
    """Rows beyond the first of a key, on the line."""
    return _graded(F.count("*") - F.count_distinct(F.struct(*keys)), F.count("*"), rates)


def holds(rule: Column) -> Column:
    """Share of the rows for which the rule is known that keep it."""
    return _share(F.count_if(~rule), F.count(rule))


def consistent(rule: Column, rates: tuple[float, float] = INCONSISTENT) -> Column:
    """Rows that break a rule, of those for which it is known, on the line."""
    return _graded(F.count_if(~rule), F.count(rule), rates)


def pm25_le_pm10(tolerance: float = 1.05) -> Column:
    return consistent(F.col("pm2_5") <= F.col("pm10") * tolerance)


def rain_le_precipitation(tolerance: float = 0.1) -> Column:
    return consistent(F.col("rain") <= F.col("precipitation") + tolerance)


def apparent_temperature_near(most: float = 25.0) -> Column:
    return consistent(F.abs(F.col("apparent_temperature") - F.col("temperature_2m")) <= most)


def daily_extremes(columns: list[str]) -> Column | None:
    """Least values beyond the greatest ones, over all pairs that there are; None without any."""
    pairs = [p for p in EXTREMES if set(p) <= set(columns)]
    if not pairs:
        return None
    rules = [F.col(lo) <= F.col(hi) for lo, hi in pairs]
    return _graded(sum((F.count_if(~r) for r in rules), F.lit(0)), sum((F.count(r) for r in rules), F.lit(0)), INCONSISTENT)


def index_matches_level(columns: list[str]) -> Column | None:
    """Levels that aren't those of the index beside them; None without such columns."""
    level = next((c for c in ("aqi_level", "dominant_aqi_level") if c in columns), None)
    index = next((c for c in ("european_aqi", "aqi_max", "aqi_avg") if c in columns), None)
    return consistent(S.aqi_level(F.col(index)) == F.col(level)) if level and index else None


def observed_hours(ideal: float = 24.0, least: float = 20.0, column: str = "obs_hours") -> Column:
    """Mean hours behind a day: 100 at the ideal, 0 at the least."""
    return S.linear_score(F.least(F.lit(1.0), F.avg(column) / ideal), 1.0, least / ideal)


#: Physical types that serve a declared one.
TYPES = {"string": {"string"}, "double": {"double", "float"}, "integer": {"bigint", "int", "smallint", "tinyint"}, "timestamp": {"timestamp_ntz", "timestamp"}, "date": {"date"}, "boolean": {"boolean"}}


def type_conformance(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """column, declared and actual type of every declared column and whether they agree; a column that isn't
    there has no actual type. The score is the share that agrees."""
    actual = dict(df.dtypes)
    rows = [(c, t, actual.get(c), actual.get(c) in TYPES[t]) for c, t in declared.items()]
    return df.sparkSession.createDataFrame(rows, "column string, declared string, actual string, agrees boolean")


def coverage(time: str, expected: int) -> Column:
    return 100.0 * F.least(F.lit(1.0), F.count_distinct(time) / F.greatest(F.lit(1), F.lit(expected)))


@dataclass(frozen=True)
class Span:
    """The hours that a check looks at: ``hours`` long, ending ``anchor`` hours after now (before it if negative,
    as for archives; after it for forecasts), with one more hour at the end."""

    hours: float = 48.0
    anchor: float = 0.0
    step: float = 1.0  # hours between rows; 24 for days, whose now is midnight

    def bounds(self, now: Column) -> tuple[Column, Column]:
        now = F.date_trunc("day", now).cast("timestamp_ntz") if self.step >= 24 else now
        minutes = lambda h: F.make_dt_interval(mins=F.lit(int(round(h * 60))))
        end = now + minutes(self.anchor)
        return end - minutes(self.hours), end + minutes(1.0)


def in_span(df: DataFrame, span: Span, time: str = "time", now: str = "local_now") -> DataFrame:
    """Rows inside the span of their own city's clock (column ``now``); without a clock all rows."""
    low, high = span.bounds(F.col(now))
    return df.where(F.col(now).isNull() | F.col(time).cast("timestamp_ntz").between(low, high))


def time_coverage(df: DataFrame, span: Span, time: str = "time", now: str = "local_now") -> DataFrame:
    """city_id and coverage (percent) of every city that has rows: distinct times inside the span of those that
    should be there; a city without any inside has 0. The score of a table is the mean of its cities."""
    low, high = span.bounds(F.col(now))
    inside = F.col(now).isNull() | F.col(time).cast("timestamp_ntz").between(low, high)
    expected = max(1.0, span.hours / span.step)
    return df.groupBy("city_id").agg((100.0 * F.least(F.lit(1.0), F.count_distinct(F.when(inside, F.col(time))) / expected)).alias("coverage"))


def freshness(time: str, as_of: Column, sla_minutes: int, factor: float = 3.0) -> Column:
    """100 up to the agreed delay, 0 from ``factor`` times that on; only what has arrived (up to an hour ahead)
    counts, and only rows ahead of that are no delay. Null times alone score 0."""
    stamp = F.col(time).cast("timestamp_ntz")
    late = F.timestamp_diff("SECOND", F.max(F.when(stamp <= as_of + F.expr("INTERVAL 1 HOUR"), stamp)), as_of) / 60.0
    score = S.clamp(100.0 * (1 - (late - sla_minutes) / max(1.0, (factor - 1) * sla_minutes)))
    return F.when(F.count("*") == 0, None).when(F.count(stamp) == 0, 0.0).when(late.isNull() | (late <= sla_minutes), 100.0).otherwise(score)


def run_success(status: str = "status") -> Column:
    return 100.0 * F.try_divide(F.count_if(F.col(status) == "success") + 0.5 * F.count_if(F.col(status) == "partial"), F.count("*"))


def freshness_state(assets: DataFrame, now: Column) -> DataFrame:
    """assets (asset_key, time_column, latest_data_time, latest_run_at, sla_minutes) with what its delay is
    measured from, delay, state (no_data, unknown, breached, healthy) and whether it breaks the agreement; tables
    without a time column go by their last run."""
    timeless = F.col("latest_data_time").isNull() & F.col("time_column").isNull()
    since = F.when(timeless, F.col("latest_run_at")).otherwise(F.col("latest_data_time"))
    delay = F.timestamp_diff("SECOND", since, now) / 60.0
    state = F.when(since.isNull(), "no_data").when(F.col("sla_minutes").isNull(), "unknown").when(delay > F.col("sla_minutes"), "breached").otherwise("healthy")
    d = assets.withColumns({"basis": F.when(timeless, "last_run").otherwise("data_time"), "delay_minutes": F.round(delay, 1), "state": state})
    return d.withColumn("breached", F.col("state").isin("no_data", "breached"))


def isolated(spark, runs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Results of several evaluations one after the other; one that fails, when planned or run, leaves a row of
    status error with its message and doesn't stop the others. Results are small: a row for each check."""
    columns = "asset string, check string, dimension string, severity string, score double, status string, message string"
    out = []
    for asset, run in runs.items():
        try:
            out += [(asset, r["check"], r["dimension"], r["severity"], r["score"], r["status"], None) for r in run().collect()]
        except PySparkException as e:
            out.append((asset, None, None, None, None, "error", str(e).splitlines()[0][:300]))
    return spark.createDataFrame(out, columns)


def evaluate(df: DataFrame, checks: list[Check], by: list[str] | None = None) -> DataFrame:
    """check, dimension, severity, score and status of every check, from one aggregate (by group)."""
    by = by or []
    row = df.groupBy(*by).agg(*(F.round(c.score, 2).alias(f"s{i}") for i, c in enumerate(checks)))
    rows = [F.struct(F.lit(c.name).alias("check"), F.lit(c.dimension).alias("dimension"), F.lit(c.severity).alias("severity"), F.col(f"s{i}").cast("double").alias("score")) for i, c in enumerate(checks)]
    out = row.select(*by, F.inline(F.array(*rows)))
    return out.withColumn("status", F.when(F.col("score").isNull(), "skipped").when(F.col("score") >= PASS, "passed").when(F.col("score") >= WARN, "warning").otherwise("failed"))


def roll_up(results: DataFrame, weights: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Total and grade: severities weigh the checks of a dimension, weights the dimensions that have
    a score."""
    by = by or []
    w = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity"))
    dims = results.where("score IS NOT NULL").groupBy(*by, "dimension").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))
    dw = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("dimension"))
    total = dims.groupBy(*by).agg((F.sum(F.col("score") * dw) / F.sum(dw)).alias("total"), F.count("*").alias("dimensions"))
    grade = F.when(F.col("total") >= GRADES[0][0], GRADES[0][1])
    for bound, g in GRADES[1:]:
        grade = grade.when(F.col("total") >= bound, g)
    return total.withColumn("grade", grade.otherwise("E"))
