"""Checks compiled from configuration: scores, counts, samples, isolation and plans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from aerolake import registry_rules
from aerolake.plans import checks

NOW = dt.datetime(2024, 3, 10, 12)
SCHEMA = "city_id string, time timestamp_ntz, pm2_5 double, pm10 double, rain double, precipitation double, temperature_2m double, apparent_temperature double, european_aqi double, aqi_level string, obs_hours int, temp_min double, temp_max double, code int, part string, n int"
ASSET = checks.Asset.of({
    "key": "city.hourly", "entity": "city_id", "time": "time", "sla_freshness_minutes": 60, "primary_key": ["city_id", "time"],
    "columns": [{"name": "pm2_5", "type": "double", "nullable": False, "range": [0, 100]}, {"name": "code", "type": "integer", "enum": [1, 2.0, "3"]}, {"name": "part", "type": "string", "enum": ["a", "b"]}, {"name": "n", "type": "double"}],
})
RULES = """
defaults: {evaluation_window_hours: 24}
checks:
  - {key: completeness.null_rate, severity: critical}
  - {key: completeness.obs_hours, severity: minor}
  - {key: completeness.time_coverage}
  - {key: timeliness.freshness}
  - {key: validity.range}
  - {key: validity.enum}
  - {key: validity.type_conformance}
  - {key: consistency.pm25_le_pm10}
  - {key: consistency.rain_le_precipitation, params: {tolerance_mm: 0.5}}
  - {key: consistency.apparent_temp_deviation}
  - {key: consistency.daily_extremes}
  - {key: consistency.aqi_matches_level}
  - {key: uniqueness.primary_key}
  - {key: no.such_check}
  - {key: consistency.rule, name: other, applies_to: ["else.*"], params: {columns: [n], holds: n > 0}}
"""


def hourly(spark, bad=0):
    """26 hours of two cities; in city a every value is wrong ``bad`` hours long; one row is doubled, one is old."""
    rows = []
    for c in ("a", "b"):
        for h in range(26):
            wrong = c == "a" and h < bad
            rows.append((c, NOW - dt.timedelta(hours=h), None if wrong and h == 0 else 150.0 if wrong else 10.0, 20.0, 2.0 if wrong else 0.4, 0.0, 10.0, 50.0 if wrong else 11.0, 15.0, "极差" if wrong else "优", 12 if wrong else 24, 5.0, 1.0 if wrong else 6.0, 7 if wrong else 1, "z" if wrong else "a", h))
    rows.append(rows[30])
    rows.append(("a", NOW - dt.timedelta(days=9), -5.0, 20.0, 9.0, 0.0, 0.0, 90.0, 15.0, "x", 1, 9.0, 1.0, 9, "old", 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clocks(spark):
    return spark.createDataFrame([("a", NOW), ("b", NOW + dt.timedelta(hours=2))], "entity string, local_now timestamp_ntz")


def results(df):
    return {r["check"]: r for r in df.collect()}


def test_all_checks(spark):
    got = results(checks.lazy(hourly(spark, 3), ASSET, RULES, clocks(spark)))
    assert set(got) == {r["key"] for r in checks.load(RULES)["checks"]} - {"consistency.rule"}
    count = {k: (r["checked"], r["failed"]) for k, r in got.items()}
    # a: 25 hours and its window; b: its clock is two hours ahead, so 23 hours, and its doubled row.
    assert count["completeness.null_rate"] == (25 + 24, 1) and count["validity.range"] == (24 + 24, 2)
    assert count["validity.enum"] == (2 * (25 + 24), 6) and count["consistency.rain_le_precipitation"] == (49, 3)
    assert count["consistency.pm25_le_pm10"] == (48, 2) and count["consistency.apparent_temp_deviation"] == (49, 3)
    assert count["consistency.daily_extremes"] == (49, 3) and count["uniqueness.primary_key"] == (49, 1)
    assert count["completeness.time_coverage"] == (48, 1) and got["completeness.time_coverage"]["score"] == pytest.approx((100 + 100 * 23 / 24) / 2, abs=0.01)
    assert count["timeliness.freshness"] == (2, 1) and got["timeliness.freshness"]["score"] == pytest.approx((100 + 50) / 2)
    assert count["completeness.obs_hours"] == (49, 3) and got["completeness.obs_hours"]["score"] == pytest.approx(100 * ((46 * 24 + 36) / 49 / 24 - 20 / 24) / (1 - 20 / 24), abs=0.01)
    assert count["validity.type_conformance"] == (4, 1) and [s["value"] for s in got["validity.type_conformance"]["samples"]] == ["n: double, int"]
    assert got["no.such_check"]["status"] == "skipped" and got["validity.type_conformance"]["status"] == "warning"
    assert [(s["part"], s["entity"], s["time"], s["value"]) for s in got["validity.range"]["samples"]] == [("pm2_5", "a", "2024-03-10 10:00:00", "150.000"), ("pm2_5", "a", "2024-03-10 11:00:00", "150.000")]
    assert [s["value"] for s in got["consistency.rain_le_precipitation"]["samples"]] == ["2.000, 0.000"] * 3
    assert [(s["entity"], s["value"]) for s in got["uniqueness.primary_key"]["samples"]] == [("b", "2 rows")]
    assert {s["part"] for s in got["validity.enum"]["samples"]} == {"code", "part"}
    assert got["consistency.aqi_matches_level"]["failed"] == 3 and got["consistency.daily_extremes"]["samples"][0]["value"] == "5.000, 1.000"
    assert got["validity.range"]["message"] == "2 of 48 fail" and got["completeness.null_rate"]["severity"] == "critical"
    alone = results(checks.run(hourly(spark, 3), ASSET, RULES, clocks(spark)))
    assert alone == got


def test_samples_stay_few(spark):
    """A table full of violations gives as many samples as a nearly clean one, the least by entity and time."""
    d = spark.range(0, 40_000, 1, 8).select(F.concat(F.lit("c"), F.col("id") % 50).alias("city_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id DIV 50 AS INT))").alias("time"), F.lit(500.0).alias("pm2_5"))
    a = checks.Asset.of({"key": "k", "entity": "city_id", "time": "time", "columns": [{"name": "pm2_5", "type": "double", "range": [0, 1]}]})
    got = results(checks.lazy(d, a, {"checks": [{"key": "validity.range"}]}))["validity.range"]
    assert (got["checked"], got["failed"], got["score"]) == (40_000, 40_000, 0.0)
    assert [(s["entity"], s["time"]) for s in got["samples"]] == [("c0", f"2024-01-01 0{h}:00:00") for h in range(3)]


def test_empty_and_odd_tables(spark):
    none = results(checks.lazy(hourly(spark).where("false"), ASSET, RULES, clocks(spark)))
    assert {k for k, r in none.items() if r["status"] != "skipped"} == {"validity.type_conformance"}
    assert none["validity.range"]["message"] == "nothing to judge"
    timeless = checks.Asset.of({"key": "k", "entity": "city_id", "primary_key": ["city_id", "n"], "columns": [{"name": "pm2_5", "range": [0, 100]}]})
    got = results(checks.lazy(hourly(spark, 3).withColumn("city_id", F.lit(None).cast("string")), timeless, RULES))
    assert got["validity.range"]["failed"] == 3 and got["validity.range"]["samples"][0]["entity"] == "null" and got["validity.range"]["samples"][0]["time"] is None
    assert got["timeliness.freshness"]["status"] == "skipped" and got["uniqueness.primary_key"]["failed"] == 28
    missing = results(checks.lazy(hourly(spark).select("city_id", "time"), ASSET, RULES))
    assert missing["consistency.pm25_le_pm10"]["message"] == "no column pm2_5, pm10"


def test_one_scan_for_rows_and_one_for_keys(spark, tmp_path):
    hourly(spark).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    row_checks = {"checks": [r for r in checks.load(RULES)["checks"] if r["key"].startswith(("validity", "consistency.p", "consistency.r", "completeness.null"))]}
    plan = checks.lazy(d, ASSET, row_checks)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Relation \\[", plan)) == 1
    plan = checks.lazy(d, ASSET, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Relation \\[", plan)) == 2


def test_isolation(spark):
    """Whatever fails, when compiled, analysed or run, has an error row; the rest have their scores."""
    rules = dict(registry_rules._FIVE)
    rules["checks"] = [*rules["checks"], {"key": "consistency.rule", "name": "no_params"}, {"key": "completeness.time_coverage", "name": "bad_number", "params": {"span_hours_by_asset": {"city.hourly": "many"}}}]
    d = hourly(spark, 3).withColumns({"v": F.col("pm2_5"), "kind": F.when(F.col("n") == 4, "error").otherwise("fine")})
    got = results(checks.run(d, ASSET, rules))
    assert {k for k, r in got.items() if r["status"] == "error"} == {"unknown_function", "fails_when_run", "no_params", "bad_number"}
    assert "a bad row" in got["fails_when_run"]["message"] and "no_such_function" in got["unknown_function"]["message"]
    assert got["fits"]["failed"] == 2 and got["validity.range"]["score"] is not None and got["uniqueness.primary_key"]["failed"] == 1


def test_anchor_and_span_by_asset(spark):
    rules = {"checks": [{"key": "completeness.time_coverage", "params": {"anchor_hours_by_asset": {"city.hourly": -10, "*": 5}, "span_hours_by_asset": {"city.hourly": 20}}}]}
    got = results(checks.lazy(hourly(spark), ASSET, rules, clocks(spark)))["completeness.time_coverage"]
    # From 30 to 10 hours before the clock (and one hour more): 17 hours of a and 15 of b, whose clock is ahead... of 20.
    assert (got["checked"], got["failed"]) == (40, 40 - 17 - 19)
    with pytest.raises(ValueError, match="two compilers"):
        checks.compiles("validity.range")(lambda c: None)
