"""Queries of the read model, episodes, quality, catalog, exports and reports, with DuckDB counterparts.

Roles: event types are cities and their hourly means the environment; orders are runs and scores; parts and nations are
assets; suppliers are columns and files.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import scalars
from aerolake.functions import standards as S
from aerolake.operators import joins, patterns, report, similar, stats
from aerolake.plans import catalog, derive, episodes, insights, jobs, quality, read_model
from aerolake.registry import _CHINA, _EURO, DAYS, HOURS, OFF_TIES, days, features, hours, query, rounded, table
from aerolake.sinks import exports
from aerolake.sources import endpoints, lake
from aerolake.sources import query as reading
from aerolake.streaming import ingest

NOW = "2024-01-20 12:00:00"

# --- the environment of the driver's events ---------------------------------------------------------

#: Hourly columns as parts of the mean value.
_PARTS = {"european_aqi": 0.5, "temperature_2m": 0.25, "pm2_5": 1.0, "pm10": 1.5, "precipitation": 0.125, "wind_speed_10m": 0.0625, "relative_humidity_2m": 0.375}
_HOURLY = f"{HOURS}, env AS (SELECT entity AS city_id, time, value, " + ", ".join(f"value * {p} AS {c}" for c, p in _PARTS.items()) + f", CAST(floor(value) AS INT) % 100 AS weather_code, CASE WHEN time > TIMESTAMP '{NOW}' THEN 1 ELSE 0 END AS is_forecast, CASE WHEN value < 30 THEN 1 ELSE 0 END AS is_stagnant FROM h)"
_CITIES = "cities AS (SELECT city_id, upper(city_id) AS name, CASE city_id WHEN 'click' THEN 'Asia/Tokyo' WHEN 'signup' THEN 'America/Panama' ELSE 'Mars/Base' END AS timezone, city_id <> 'view' AS active FROM (SELECT DISTINCT event_type AS city_id FROM events))"
_DAILY = f"{_HOURLY}, daily AS (SELECT city_id, CAST(time AS DATE) AS date, avg(european_aqi) AS aqi_avg, max(european_aqi) AS aqi_max, avg(temperature_2m) AS temp_avg, sum(precipitation) AS precipitation_sum, count(*) FILTER (value > 60) AS exceed_hours, count(*) AS obs_hours, CASE WHEN avg(value) <= 50 THEN 1 ELSE 0 END AS good_air_day FROM env GROUP BY 1, 2)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    d = hours(spark, sf_dir).withColumnRenamed("entity", "city_id")
    return d.withColumns({**{c: v * p for c, p in _PARTS.items()}, "weather_code": F.floor(v).cast("int") % 100, "is_forecast": (F.col("time") > F.lit(NOW).cast("timestamp_ntz")).cast("int"), "is_stagnant": (v < 30).cast("int")})


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("city_id")).distinct()
    zone = F.when(F.col("city_id") == "click", "Asia/Tokyo").when(F.col("city_id") == "signup", "America/Panama").otherwise("Mars/Base")
    return d.select("city_id", F.upper("city_id").alias("name"), zone.alias("timezone"), (F.col("city_id") != "view").alias("active"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).groupBy("city_id", F.to_date("time").alias("date"))
    return d.agg(F.avg("european_aqi").alias("aqi_avg"), F.max("european_aqi").alias("aqi_max"), F.avg("temperature_2m").alias("temp_avg"), F.sum("precipitation").alias("precipitation_sum"), F.count_if(F.col("value") > 60).alias("exceed_hours"), F.count("*").alias("obs_hours"), F.when(F.avg("value") <= 50, 1).otherwise(0).alias("good_air_day"))


# The labels, colours and advice once more, as literals.
_WEATHER = "wl(code, label) AS (VALUES (0, '晴'), (1, '晴间多云'), (2, '多云'), (3, '阴'), (45, '雾'), (48, '雾凇'), (51, '毛毛雨（弱）'), (53, '毛毛雨（中）'), (55, '毛毛雨（强）'), (56, '冻毛毛雨（弱）'), (57, '冻毛毛雨（强）'), (61, '小雨'), (63, '中雨'), (65, '大雨'), (66, '冻雨（弱）'), (67, '冻雨（强）'), (71, '小雪'), (73, '中雪'), (75, '大雪'), (77, '米雪'), (80, '阵雨（弱）'), (81, '阵雨（中）'), (82, '阵雨（强）'), (85, '阵雪（弱）'), (86, '阵雪（强）'), (95, '雷阵雨'), (96, '雷阵雨伴小冰雹'), (99, '雷阵雨伴强冰雹'))"
_LEVELS = "lv(level, color, advice) AS (VALUES ('优', '#00e400', '空气质量令人满意，可正常户外活动。'), ('良', '#ffff00', '空气质量可接受，极少数敏感人群应减少户外剧烈运动。'), ('轻度污染', '#ff7e00', '易感人群症状轻度加剧，儿童、老年人及心肺疾病患者应减少长时间户外活动。'), ('中度污染', '#ff0000', '进一步加剧易感人群症状，建议疾病患者避免长时间户外活动，一般人群适量减少户外运动。'), ('重度污染', '#99004c', '心脏病和肺病患者症状显著加剧，建议儿童、老年人和心脏病、肺病患者停留在室内，停止户外运动。'), ('严重污染', '#7e0023', '健康人群运动耐受力降低，建议儿童、老年人和病人留在室内，避免体力消耗，一般人群应避免户外活动。'))"
_CURRENT = f"{_HOURLY}, {_CITIES}, now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY is_forecast, time DESC) AS n FROM env) WHERE n = 1)"
_ALERTED = f"""{_CURRENT}, al AS (SELECT city_id, time, 'european_aqi' AS metric, european_aqi AS value, CASE WHEN european_aqi >= 100 THEN 'air.severe_pollution' WHEN european_aqi >= 80 THEN 'air.heavy_pollution' WHEN european_aqi >= 60 THEN 'air.moderate_pollution' WHEN european_aqi >= 40 THEN 'air.light_pollution' END AS key, CASE WHEN european_aqi >= 80 THEN 'severe' WHEN european_aqi >= 60 THEN 'warning' ELSE 'info' END AS severity FROM now WHERE european_aqi >= 40
UNION ALL SELECT city_id, time, 'temperature_2m', temperature_2m, CASE WHEN temperature_2m >= 35 THEN 'weather.heat_wave' WHEN temperature_2m >= 32 THEN 'weather.heat_warning' ELSE 'weather.frost' END, CASE WHEN temperature_2m >= 35 OR temperature_2m <= -10 THEN 'severe' ELSE 'warning' END FROM now WHERE temperature_2m >= 32 OR temperature_2m <= -10
UNION ALL SELECT city_id, time, 'precipitation', precipitation, 'weather.heavy_rain', 'severe' FROM now WHERE precipitation >= 8
UNION ALL SELECT city_id, time, 'wind_speed_10m', wind_speed_10m, 'weather.gale', 'warning' FROM now WHERE wind_speed_10m >= 50)"""


@query(f"WITH {_CURRENT}, {_WEATHER}, {_LEVELS}, l AS (SELECT *, {_EURO.format(c='european_aqi')} AS level FROM now) SELECT city_id, name AS city_name, time, round(european_aqi, 4) AS european_aqi, level AS aqi_level, color AS aqi_color, advice AS health_advice, coalesce(label, '未知') AS weather_label, CASE WHEN is_forecast > 0 THEN '预报' ELSE '实况' END AS data_kind FROM l JOIN cities USING (city_id) JOIN lv USING (level) LEFT JOIN wl ON code = weather_code")
def current_conditions(spark, sf_dir):
    d = read_model.current(hourly(spark, sf_dir), cities(spark, sf_dir))
    return rounded(d.select("city_id", "city_name", "time", "european_aqi", "aqi_level", "aqi_color", "health_advice", "weather_label", "data_kind"))


@query(f"WITH {_ALERTED} SELECT city_id, upper(city_id) AS city_name, time AS observed_at, key, metric, round(ROUND(value, 2), 2) AS value, severity FROM al")
def active_alerts(spark, sf_dir):
    return rounded(read_model.alert_list(read_model.current(hourly(spark, sf_dir), cities(spark, sf_dir))).drop("threshold"), 2)


@query(f"WITH {_ALERTED} SELECT severity, count(*) AS n, (SELECT count(*) FROM now) AS cities_monitored FROM al GROUP BY 1")
def alert_counts(spark, sf_dir):
    return read_model.alert_counts(read_model.current(hourly(spark, sf_dir), cities(spark, sf_dir)))


@query(f"WITH {_CURRENT}, u AS (SELECT city_id, 'worst_air' AS ranking, european_aqi AS score FROM now UNION ALL SELECT city_id, 'best_air', -european_aqi FROM now UNION ALL SELECT city_id, 'hottest', temperature_2m FROM now UNION ALL SELECT city_id, 'wettest', precipitation FROM now), k AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, city_id) AS place FROM u) SELECT city_id AS entity, ranking, round(score, 4) AS score, place FROM k WHERE place <= 3")
def city_rankings(spark, sf_dir):
    return rounded(read_model.city_rankings(read_model.current(hourly(spark, sf_dir), cities(spark, sf_dir)), 3))


@query(f"WITH {_HOURLY} SELECT time, is_forecast, weather_code, round(pm10, 4) AS pm10, round(european_aqi, 4) AS european_aqi FROM env WHERE city_id = 'click' AND time BETWEEN TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND TIMESTAMP '{NOW}' + INTERVAL 72 HOUR")
def hourly_series(spark, sf_dir):
    return rounded(read_model.hourly_series(hourly(spark, sf_dir), "click", NOW, 72, ["pm10", "no_such", "european_aqi"]))


@query(f"WITH {_HOURLY} SELECT city_id AS entity, CASE WHEN bool_or(is_forecast > 0) AND NOT bool_and(is_forecast > 0) THEN min(time) FILTER (is_forecast > 0) END AS boundary FROM env GROUP BY 1")
def forecast_boundary(spark, sf_dir):
    return read_model.forecast_boundary(hourly(spark, sf_dir))


@query(f"WITH {_DAILY} SELECT strftime(date, '%Y-%m-%d') AS date, round(aqi_avg, 4) AS aqi_avg, round(aqi_max, 4) AS aqi_max, round(precipitation_sum, 4) AS precipitation_sum, exceed_hours, {_EURO.format(c='aqi_max')} AS aqi_level FROM daily WHERE city_id = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def daily_series(spark, sf_dir):
    d = read_model.daily_series(daily(spark, sf_dir), "click", "2024-01-20", 15)
    return rounded(d.select(F.col("date").cast("string").alias("date"), "aqi_avg", "aqi_max", "precipitation_sum", "exceed_hours", "aqi_level"))


@query(f"""WITH {_DAILY}, x AS (SELECT city_id, min(aqi_avg) AS lo, max(aqi_avg) AS hi FROM daily GROUP BY 1), e AS (SELECT city_id, strftime(min(date) FILTER (aqi_avg = lo), '%Y-%m-%d') AS best_day, strftime(min(date) FILTER (aqi_avg = hi), '%Y-%m-%d') AS worst_day FROM daily JOIN x USING (city_id) GROUP BY 1)
SELECT city_id, count(*) AS days, round(avg(aqi_avg), 4) AS aqi_avg, round(max(aqi_avg), 4) AS aqi_max, round(avg(temp_avg), 4) AS temp_avg, round(sum(precipitation_sum), 4) AS precipitation_total, CAST(sum(exceed_hours) AS BIGINT) AS exceed_hours_total, CAST(sum(good_air_day) AS BIGINT) AS good_air_days, round(ROUND(100.0 * sum(good_air_day) / count(*), 1), 4) AS good_air_rate, any_value(best_day) AS best_day, any_value(worst_day) AS worst_day, {_EURO.format(c='min(aqi_avg)')} AS best_level, {_EURO.format(c='max(aqi_avg)')} AS worst_level FROM daily JOIN e USING (city_id) GROUP BY 1""")
def daily_summary(spark, sf_dir):
    d = read_model.daily_summary(daily(spark, sf_dir)).drop("best_aqi", "worst_aqi")
    return rounded(d.withColumns({c: F.col(c).cast("string") for c in ("best_day", "worst_day")}))


@query(f"WITH {_CITIES} SELECT city_id, name, TIMESTAMP '{NOW}' + to_hours(CASE city_id WHEN 'click' THEN 9 WHEN 'signup' THEN -5 ELSE 0 END) AS local_now FROM cities WHERE active")
def city_index(spark, sf_dir):
    return read_model.city_index(cities(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("city_id", "name", "local_now")


@query(f"WITH {_HOURLY} SELECT city_id AS entity, strftime(time, '%Y-%m-%d') AS bucket, round(avg(pm2_5), 4) AS mean, count(*) AS n FROM env WHERE city_id IN ('click', 'view') AND time >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR GROUP BY 1, 2")
def compare_daily(spark, sf_dir):
    return rounded(read_model.compared(hourly(spark, sf_dir), ["click", "view"], "pm2_5", NOW, 168, "day"))


_DICTIONARY = "dict AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pm2_5' WHEN 1 THEN 'cloud_cover' WHEN 2 THEN 'city_id' ELSE 'other_' || p_partkey END AS name, CASE p_size % 3 WHEN 0 THEN 'double' WHEN 1 THEN 'string' ELSE 'integer' END AS type, 'µg/m³' AS unit, CASE WHEN p_size > 5 THEN p_name || '（' || p_type || '）' END AS description FROM part)"


@query(f"WITH {_DICTIONARY} SELECT name, CASE WHEN description IS NULL THEN name ELSE split_part(description, '（', 1) END AS label, description, unit, type, type IN ('double', 'integer') AS numeric, name = 'pm2_5' AS core, name IN ('pm2_5', 'cloud_cover') AS comparable FROM dict WHERE name <> 'city_id'")
def metric_catalog(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 4 == 0, "pm2_5").when(k % 4 == 1, "cloud_cover").when(k % 4 == 2, "city_id").otherwise(F.concat(F.lit("other_"), k))
    kind = F.when(size % 3 == 0, "double").when(size % 3 == 1, "string").otherwise("integer")
    d = table(spark, sf_dir, "part").select(name.alias("name"), kind.alias("type"), F.lit("µg/m³").alias("unit"), F.when(size > 5, F.concat("p_name", F.lit("（"), "p_type", F.lit("）"))).alias("description"))
    return read_model.metric_catalog(d)


@query("SELECT n_name AS asset_key, count(s_suppkey) > 0 AS available, CAST(count(DISTINCT s_name) AS INT) AS n_cities, coalesce(min(s_name), '-') AS first_city FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY 1")
def availability(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("asset_key"), F.when(F.col("n_regionkey") == 0, "retired").otherwise("active").alias("status"), "n_nationkey")
    files = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("asset_key", F.col("s_name").alias("city"))
    d = read_model.availability(files, n.drop("n_nationkey"))
    return d.select("asset_key", "available", F.size("cities").alias("n_cities"), F.coalesce(F.get("cities", 0), F.lit("-")).alias("first_city"))


@query(f"WITH {_DAILY}, {_CITIES} SELECT kind, city_id, n FROM (SELECT 'hourly' AS kind, city_id, count(*) AS n FROM env WHERE time >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND value > 5 GROUP BY 2 UNION ALL SELECT 'archive', city_id, count(*) FROM env WHERE time >= TIMESTAMP '2024-01-04' AND time < TIMESTAMP '2024-01-15' GROUP BY 2 UNION ALL SELECT 'daily', city_id, count(*) FROM daily WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 2) WHERE city_id IN (SELECT city_id FROM cities WHERE active)")
def loader_windows(spark, sf_dir):
    h, c = hourly(spark, sf_dir), cities(spark, sf_dir)
    some = h.withColumn("pm2_5", F.when(F.col("value") > 5, F.col("pm2_5")))
    n = lambda d, kind: d.groupBy("city_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "city_id", "n")
    parts = [read_model.window(some, c, NOW, 10, "hourly", columns=["city_id", "time", "pm2_5"], require=["pm2_5"]), read_model.window(h, c, NOW, 10, "archive"), read_model.window(daily(spark, sf_dir), c, NOW, 10, "daily")]
    return n(parts[0], "hourly").unionAll(n(parts[1], "archive")).unionAll(n(parts[2], "daily"))


# --- episodes -------------------------------------------------------------------------------------------

_EPISODES = f"""{_HOURLY}, p AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY time) AS p, count(*) OVER (PARTITION BY city_id) AS total FROM env),
o AS (SELECT city_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY city_id ORDER BY p) - 1 > 3 THEN 1 ELSE 0 END AS g FROM p WHERE value > 60), s AS (SELECT city_id, p, sum(g) OVER (PARTITION BY city_id ORDER BY p) AS seg FROM o), b AS (SELECT city_id, seg, min(p) AS a, max(p) AS z FROM s GROUP BY 1, 2),
f AS (SELECT b.city_id, min(time) AS start_time, max(time) AS end_time, count(*) AS duration, max(value) AS peak, arg_max(time, struct_pack(v := value, k := -p.p)) AS peak_time, avg(value) AS mean, count(*) FILTER (european_aqi > 60) AS exceed_hours, ROUND(avg(pm2_5), 2) AS pm2_5_mean, ROUND(avg(pm10), 2) AS pm10_mean, ROUND(avg(wind_speed_10m), 2) AS wind, ROUND(avg(relative_humidity_2m), 1) AS humidity, ROUND(sum(precipitation), 2) AS rain, CAST(sum(is_stagnant) AS BIGINT) AS stagnant_hours, any_value(total) AS total FROM b JOIN p ON p.city_id = b.city_id AND p.p BETWEEN a AND z GROUP BY b.city_id, seg),
g AS (SELECT *, {_CHINA.format(c='peak', null='NULL')} AS peak_level, CASE WHEN peak <= 50 THEN 0 WHEN peak <= 100 THEN 1 WHEN peak <= 150 THEN 2 WHEN peak <= 200 THEN 3 WHEN peak <= 300 THEN 4 ELSE 5 END * 10 + least(duration, 24) AS points, 1.0 * duration / total AS share FROM f WHERE duration >= 2),
ep AS (SELECT *, CASE WHEN points >= 50 THEN '严重' WHEN points >= 35 THEN '较重' WHEN points >= 22 THEN '中等' ELSE '轻微' END AS severity, share > 0.25 AS chronic FROM g)"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episodes(hourly(spark, sf_dir), "value", 60.0)


@query(f"WITH {_EPISODES} SELECT city_id, start_time, end_time, peak_time, duration, exceed_hours, round(peak, 2) AS peak, round(mean, 2) AS mean, peak_level, severity, chronic, round(ROUND(100.0 * share, 1), 2) AS window_share, round(pm2_5_mean, 1) AS pm2_5_mean, round(pm10_mean, 1) AS pm10_mean, round(wind, 1) AS wind_speed_avg, round(humidity, 0) AS humidity_avg, round(rain, 1) AS precipitation_sum, stagnant_hours FROM ep")
def episode_facts(spark, sf_dir):
    d = _episodes(spark, sf_dir)
    coarse = {"pm2_5_mean": 1, "pm10_mean": 1, "wind_speed_avg": 1, "humidity_avg": 0, "precipitation_sum": 1}
    d = rounded(d.select("city_id", "start_time", "end_time", "peak_time", "duration", "exceed_hours", "peak", "mean", "peak_level", "severity", "chronic", "window_share", "stagnant_hours", *coarse), 2)
    return d.withColumns({c: F.round(F.col(c) + OFF_TIES, n) for c, n in coarse.items()})


@query(f"WITH {_EPISODES}, c AS (SELECT city_id, sum(duration) AS hours, max(peak) AS peak FROM ep GROUP BY 1), w AS (SELECT * FROM c ORDER BY hours DESC, peak DESC LIMIT 1) SELECT count(*) AS episodes, CAST(coalesce(sum(duration), 0) AS BIGINT) AS hours, count(*) FILTER (chronic) AS chronic, count(DISTINCT city_id) FILTER (chronic) AS chronic_cities, (SELECT city_id FROM w) AS worst_city, CAST((SELECT hours FROM w) AS BIGINT) AS worst_hours, round((SELECT ROUND(peak, 2) FROM w), 2) AS worst_peak FROM ep")
def episode_totals(spark, sf_dir):
    return rounded(episodes.totals(_episodes(spark, sf_dir)), 2)


@query(f"WITH {_EPISODES}, l(level, rank) AS (VALUES ('优', 0), ('良', 1), ('轻度污染', 2), ('中度污染', 3), ('重度污染', 4), ('严重污染', 5)) SELECT level, CAST(rank AS INT) AS rank, count(city_id) AS n FROM l LEFT JOIN ep ON peak_level = level GROUP BY 1, 2")
def episode_levels(spark, sf_dir):
    return episodes.level_distribution(_episodes(spark, sf_dir))


@query(f"WITH {_EPISODES} SELECT row_number() OVER (ORDER BY peak DESC, duration DESC, city_id, start_time) AS \"序号\", city_id AS \"城市\", duration AS \"持续小时\", round(peak, 2) AS \"峰值AQI\", peak_level AS \"峰值等级\", severity AS \"严重度\", CASE WHEN chronic THEN '是' ELSE '否' END AS \"持续性污染\" FROM ep ORDER BY 1 LIMIT 50")
def episode_export(spark, sf_dir):
    d = exports.episode_table(episodes.ranked(_episodes(spark, sf_dir)))
    return rounded(d.select("序号", "城市", "持续小时", "峰值AQI", "峰值等级", "严重度", "持续性污染"), 2)


# --- quality ----------------------------------------------------------------------------------------------

_BROKEN = "q AS (SELECT event_type AS city_id, ts AS time, value AS pm2_5, CASE WHEN event_id % 17 = 0 THEN value / 2 ELSE value END AS pm10, CASE WHEN event_id % 31 = 0 THEN value + 1 ELSE value END AS rain, value AS precipitation, CASE WHEN event_id % 50 = 0 THEN 60.0 ELSE 20.0 END AS apparent_temperature, CASE WHEN event_id % 7 <> 0 THEN 20.0 END AS temperature_2m, CASE WHEN event_id % 20 = 0 THEN 5.0 ELSE 1.0 END AS temp_min, 4.0 AS temp_max, value / 2 AS european_aqi, CASE WHEN event_id % 40 = 0 THEN '优' ELSE " + _EURO.format(c="value / 2") + " END AS aqi_level, 24.0 - (event_id % 3) AS obs_hours, CASE WHEN event_id % 200 = 0 THEN 0 ELSE event_id END AS key FROM events)"


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("city_id"), F.col("ts").alias("time"), v.alias("pm2_5"), F.when(k % 17 == 0, v / 2).otherwise(v).alias("pm10"), F.when(k % 31 == 0, v + 1).otherwise(v).alias("rain"), v.alias("precipitation"), F.when(k % 50 == 0, 60.0).otherwise(20.0).alias("apparent_temperature"), F.when(k % 7 != 0, 20.0).alias("temperature_2m"), F.when(k % 20 == 0, 5.0).otherwise(1.0).alias("temp_min"), F.lit(4.0).alias("temp_max"), (v / 2).alias("european_aqi"), (24.0 - k % 3).alias("obs_hours"), F.when(k % 200 == 0, 0).otherwise(k).alias("key"), k.alias("k"))
    return d.withColumn("aqi_level", F.when(F.col("k") % 40 == 0, "优").otherwise(S.aqi_level(F.col("european_aqi")))).drop("k")


def _line(bad: str, of: str, warn: float, fail: float) -> str:
    """The score of a rate of bad values as SQL."""
    x = f"(1 - 1.0 * ({bad}) / ({of}))"
    return f"CASE WHEN {x} >= {1 - warn} THEN 100.0 WHEN {x} <= {1 - fail} THEN 0.0 ELSE ROUND(({x} - {1 - fail}) / {fail - warn} * 100, 2) END"


_N = lambda rule: f"count(*) FILTER (NOT ({rule}))"
_RULED = {
    "apparent": _line(_N("abs(apparent_temperature - temperature_2m) <= 25"), "count(temperature_2m)", 0.02, 0.10),
    "duplicates": _line("count(*) - count(DISTINCT key)", "count(*)", 0.001, 0.01),
    "extremes": _line(_N("temp_min <= temp_max"), "count(*)", 0.02, 0.10),
    "level": _line(_N(f"aqi_level = {_EURO.format(c='european_aqi')}"), "count(*)", 0.02, 0.10),
    "obs_hours": "CASE WHEN least(1.0, avg(obs_hours) / 24) >= 1 THEN 100.0 WHEN avg(obs_hours) / 24 <= 20.0 / 24 THEN 0.0 ELSE ROUND((avg(obs_hours) / 24 - 20.0 / 24) / (1 - 20.0 / 24) * 100, 2) END",
    "pm25_le_pm10": _line(_N("pm2_5 <= pm10 * 1.05"), "count(*)", 0.02, 0.10),
    "rain": _line(_N("rain <= precipitation + 0.1"), "count(*)", 0.02, 0.10),
    "ranges": _line(_N("pm2_5 BETWEEN 0 AND 300") + " + " + _N("rain BETWEEN 0 AND 320"), "2 * count(*)", 0.01, 0.05),
}


@query(f"WITH {_BROKEN}, s AS (SELECT city_id, " + ", ".join(f"{x} AS {c}" for c, x in _RULED.items()) + " FROM q GROUP BY 1), u AS (" + " UNION ALL ".join(f"SELECT city_id, '{c}' AS \"check\", {c} AS score FROM s" for c in _RULED) + ") SELECT city_id, \"check\", round(ROUND(score, 2), 1) AS score, CASE WHEN ROUND(score, 2) >= 90 THEN 'passed' WHEN ROUND(score, 2) >= 70 THEN 'warning' ELSE 'failed' END AS status FROM u")
def quality_rules(spark, sf_dir):
    d = _broken(spark, sf_dir)
    scores = {"apparent": quality.apparent_temperature_near(), "duplicates": quality.no_duplicates(["key"]), "extremes": quality.daily_extremes(d.columns), "level": quality.index_matches_level(d.columns), "obs_hours": quality.observed_hours(), "pm25_le_pm10": quality.pm25_le_pm10(), "rain": quality.rain_le_precipitation(), "ranges": quality.ranges({"pm2_5": (0, 300), "rain": (0, 320)})}
    return rounded(quality.evaluate(d, [quality.Check(c, "consistency", s) for c, s in scores.items()], ["city_id"]).select("city_id", "check", "score", "status"), 1)


@query(f"WITH {_HOURLY} SELECT city_id, round(100.0 * least(1.0, count(DISTINCT time) FILTER (time BETWEEN TIMESTAMP '{NOW}' - INTERVAL 96 HOUR AND TIMESTAMP '{NOW}' - INTERVAL 47 HOUR) / 48.0), 2) AS coverage FROM env WHERE city_id <> 'view' OR time < TIMESTAMP '2024-01-10' GROUP BY 1")
def time_coverage(spark, sf_dir):
    d = hourly(spark, sf_dir).where("city_id <> 'view' OR time < TIMESTAMP_NTZ '2024-01-10 00:00:00'").withColumn("local_now", F.lit(NOW).cast("timestamp_ntz"))
    return rounded(quality.time_coverage(d, quality.Span(48, -48)), 2)


@query(f"WITH {_HOURLY}, f AS (SELECT city_id, date_diff('second', max(time) FILTER (time <= TIMESTAMP '2024-01-20 05:00:00' AND hour(time) < 9), TIMESTAMP '2024-01-20 04:00:00') / 60.0 AS late FROM env GROUP BY 1) SELECT city_id, round(CASE WHEN late <= 120 THEN 100.0 ELSE greatest(0.0, 100.0 * (1 - (late - 120) / 240.0)) END, 2) AS score FROM f")
def freshness(spark, sf_dir):
    d = hourly(spark, sf_dir).where(F.hour("time") < 9)
    return rounded(d.groupBy("city_id").agg(quality.freshness("time", F.lit("2024-01-20 04:00:00").cast("timestamp_ntz"), 120).alias("score")), 2)


@query("SELECT o_orderpriority AS job, round(100.0 * (count(*) FILTER (o_orderstatus = 'F') + 0.5 * count(*) FILTER (o_orderstatus = 'P')) / count(*), 2) AS score FROM orders GROUP BY 1")
def run_success(spark, sf_dir):
    return rounded(_runs(spark, sf_dir).groupBy("job").agg(quality.run_success().alias("score")), 2)


@query("SELECT * FROM (VALUES ('event_id', 'integer', 'bigint', true), ('ts', 'timestamp', 'timestamp_ntz', true), ('value', 'double', 'double', true), ('user_id', 'string', 'bigint', false), ('gone', 'date', '-', false)) t(\"column\", declared, actual, agrees)")
def type_conformance(spark, sf_dir):
    declared = {"event_id": "integer", "ts": "timestamp", "value": "double", "user_id": "string", "gone": "date"}
    return quality.type_conformance(table(spark, sf_dir, "events"), declared).fillna("-", ["actual"])


# --- catalog ------------------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS job, 'asset' || (o_custkey % 40) AS asset_key, 'c' || (o_custkey % 25) AS city_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status, o_orderdate AS started_at, o_totalprice AS total FROM orders)"
_SCORES = "scores AS (SELECT 'asset' || (o_custkey % 40) AS asset_key, o_orderdate AS scored_at, CAST(o_orderkey * 7 % 101 AS DOUBLE) AS total, o_orderstatus AS grade FROM orders)"
_RESULTS = "results AS (SELECT 'asset' || (o_custkey % 40) AS asset_key, o_orderpriority AS \"check\", CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'warning' END AS status, o_orderdate AS evaluated_at FROM orders)"
_ASSETS = "assets AS (SELECT 'asset' || p_partkey AS asset_key, p_name AS name, p_type AS layer, CASE WHEN p_size % 2 = 0 THEN 'air' ELSE 'weather' END AS domain, CASE WHEN p_size < 45 THEN 'active' ELSE 'retired' END AS status, p_brand AS owner, p_brand || ' of size ' || p_size AS description, TIMESTAMP '1999-06-01' - to_minutes(CAST(p_size * 10 AS BIGINT)) AS latest, CASE WHEN p_size % 3 = 0 THEN 'time' END AS time_column, CASE WHEN p_size % 5 <> 0 THEN 200 END AS sla_minutes, p_size, p_partkey FROM part)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("partial")
    return o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("job"), F.concat(F.lit("asset"), F.col("o_custkey") % 40).alias("asset_key"), F.concat(F.lit("c"), F.col("o_custkey") % 25).alias("city_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("asset"), F.col("o_custkey") % 40).alias("asset_key"), F.col("o_orderdate").alias("scored_at"), (F.col("o_orderkey") * 7 % 101).cast("double").alias("total"), F.col("o_orderstatus").alias("grade"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("warning")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("asset"), F.col("o_custkey") % 40).alias("asset_key"), F.col("o_orderpriority").alias("check"), status.alias("status"), F.col("o_orderdate").alias("evaluated_at"))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("asset"), "p_partkey").alias("asset_key"), F.col("p_name").alias("name"), F.col("p_type").alias("layer"), F.when(size % 2 == 0, "air").otherwise("weather").alias("domain"), F.when(size < 45, "active").otherwise("retired").alias("status"), F.col("p_brand").alias("owner"), F.concat("p_brand", F.lit(" of size "), size).alias("description"),
        F.array("p_brand", F.concat(F.lit("tag"), size)).alias("tags"), (F.lit("1999-06-01").cast("timestamp_ntz") - F.make_dt_interval(mins=size * 10)).alias("latest"), F.when(size % 3 == 0, "time").alias("time_column"), F.when(size % 5 != 0, 200).alias("sla_minutes"), "p_size", "p_partkey",
    )


_LAST_DAY = "1999-06-01 00:00:00"


@query(f"WITH {_ASSETS} SELECT asset_key, layer, name FROM assets WHERE domain = 'air' AND status = 'active' AND (contains(lower(asset_key), 'tag3') OR contains(lower(name), 'tag3') OR contains(lower(description), 'tag3') OR contains('tag' || p_size, 'tag3') OR p_partkey % 60 = 30 OR contains(lower(owner), 'tag3'))")
def catalog_search(spark, sf_dir):
    a = _assets(spark, sf_dir)
    columns = a.where("p_partkey % 60 = 30").select("asset_key", F.lit("column_TAG3_x").alias("name"))
    return catalog.search(a, columns, " tAg3", domain="air", status="active").select("asset_key", "layer", "name")


@query(f"WITH {_ASSETS}, f AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN NULL ELSE latest END AS data_time FROM assets), b AS (SELECT *, CASE WHEN data_time IS NULL AND time_column IS NULL THEN latest - INTERVAL 1 HOUR ELSE data_time END AS since FROM f), d AS (SELECT *, date_diff('second', since, TIMESTAMP '{_LAST_DAY}') / 60.0 AS delay FROM b) SELECT asset_key, CASE WHEN data_time IS NULL AND time_column IS NULL THEN 'last_run' ELSE 'data_time' END AS basis, CASE WHEN since IS NULL THEN 'no_data' WHEN sla_minutes IS NULL THEN 'unknown' WHEN delay > sla_minutes THEN 'breached' ELSE 'healthy' END AS state, round(coalesce(delay, -1), 1) AS delay_minutes, since IS NULL OR coalesce(delay > sla_minutes, false) AS breached FROM d")
def freshness_states(spark, sf_dir):
    a = _assets(spark, sf_dir).withColumns({"latest_data_time": F.when(F.col("p_size") % 4 != 0, F.col("latest")), "latest_run_at": F.col("latest") - F.expr("INTERVAL 1 HOUR")})
    d = quality.freshness_state(a, F.lit(_LAST_DAY).cast("timestamp_ntz")).fillna(-1.0, ["delay_minutes"])
    return rounded(d.select("asset_key", "basis", "state", "delay_minutes", "breached"), 1)


@query(f"WITH {_RUNS}, {_ASSETS}, t AS (SELECT * FROM runs WHERE status = 'failed' ORDER BY started_at DESC, run_id, city_id LIMIT 50) SELECT run_id, job, city_id, started_at, name AS asset_name FROM t LEFT JOIN assets USING (asset_key)")
def recent_runs(spark, sf_dir):
    none = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("city_id"), F.col("n_name").alias("name"))
    return catalog.recent_runs(_runs(spark, sf_dir), _assets(spark, sf_dir), none, 50, status="failed").select("run_id", "job", "city_id", "started_at", "asset_name")


@query(f"WITH {_RUNS} SELECT 'c' || n_nationkey AS city_id, n_name AS name, n_nationkey % 2 = 0 AS active, EXISTS (SELECT 1 FROM runs WHERE runs.city_id = 'c' || n_nationkey AND status = 'success' AND started_at > TIMESTAMP '2001-07-20') AS has_data FROM nation")
def city_list(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("city_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("active"))
    return catalog.city_list(n, _runs(spark, sf_dir).where("started_at > TIMESTAMP_NTZ '2001-07-20 00:00:00'"))


@query("SELECT 'c' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS city_id FROM nation WHERE n_regionkey <> 1 ORDER BY 1 LIMIT 6")
def run_cities(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("city_id"), (F.col("n_regionkey") != 1).alias("active"))
    return catalog.run_cities(n, most=6).select("city_id")


@query(f"WITH {_SCORES}, d AS (SELECT scored_at, max(total) AS total FROM scores WHERE asset_key = 'asset7' GROUP BY 1 ORDER BY 1 DESC LIMIT 20) SELECT scored_at, total FROM d")
def score_history(spark, sf_dir):
    d = _scores(spark, sf_dir).groupBy("asset_key", "scored_at").agg(F.max("total").alias("total"))
    return catalog.score_history(d, "asset7", 20).select("scored_at", "total")


@query(f"WITH {_RESULTS} SELECT asset_key, count(*) AS open_issues FROM results WHERE status IN ('failed', 'warning') AND evaluated_at >= TIMESTAMP '{_LAST_DAY}' - INTERVAL 720 HOUR GROUP BY 1")
def open_issues(spark, sf_dir):
    return catalog.open_issues(_results(spark, sf_dir), F.lit(_LAST_DAY).cast("timestamp_ntz"), 720)


@query(f"""WITH {_ASSETS}, {_RUNS}, {_SCORES}, {_RESULTS}, r AS (SELECT asset_key, count(*) AS runs, max(started_at) AS latest_run_at FROM runs GROUP BY 1), s AS (SELECT asset_key, total, grade FROM (SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY scored_at DESC, total DESC) AS n FROM scores) WHERE n = 1), i AS (SELECT asset_key, count(*) AS open_issues FROM results WHERE status IN ('failed', 'warning') AND evaluated_at >= TIMESTAMP '{_LAST_DAY}' - INTERVAL 24 HOUR GROUP BY 1)
SELECT asset_key, name, coalesce(runs, 0) AS runs, latest_run_at, coalesce(total, -1) AS total, coalesce(open_issues, 0) AS open_issues FROM assets LEFT JOIN r USING (asset_key) LEFT JOIN s USING (asset_key) LEFT JOIN i USING (asset_key)""")
def asset_details(spark, sf_dir):
    none = spark.createDataFrame([], catalog.SCHEMAS["versions"])
    d = catalog.details(_assets(spark, sf_dir), none, _runs(spark, sf_dir), _scores(spark, sf_dir), _results(spark, sf_dir), F.lit(_LAST_DAY).cast("timestamp_ntz"))
    return d.select("asset_key", "name", "runs", "latest_run_at", F.coalesce("total", F.lit(-1.0)).alias("total"), "open_issues")


@query(f"""WITH {_ASSETS}, {_RUNS}, {_SCORES}, st AS (SELECT *, date_diff('second', latest, TIMESTAMP '{_LAST_DAY}') / 60.0 > sla_minutes AS late FROM assets), l AS (SELECT asset_key, total, grade FROM (SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY scored_at DESC, total DESC) AS n FROM scores) WHERE n = 1), d AS (SELECT * FROM runs WHERE started_at >= TIMESTAMP '{_LAST_DAY}' - INTERVAL 24 HOUR), k AS (
SELECT 'assets' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM st UNION ALL SELECT 'sla_breaches', count(*) FROM st WHERE late AND status = 'active' UNION ALL SELECT 'avg_quality_score', ROUND(avg(total), 2) FROM l UNION ALL SELECT 'runs_24h', count(*) FROM d UNION ALL SELECT 'success_rate_24h', ROUND(100.0 * count(*) FILTER (status = 'success') / count(*), 1) FROM d
UNION ALL SELECT 'layer:' || layer, count(*) FROM st GROUP BY layer UNION ALL SELECT 'domain:' || domain, count(*) FROM st GROUP BY domain UNION ALL SELECT 'grade:' || grade, count(*) FROM l GROUP BY grade) SELECT kpi, round(value, 2) AS value FROM k""")
def overview(spark, sf_dir):
    a = _assets(spark, sf_dir).withColumns({"latest_data_time": F.col("latest"), "latest_run_at": F.col("latest")})
    return rounded(catalog.overview(a, _scores(spark, sf_dir), _runs(spark, sf_dir), F.lit(_LAST_DAY).cast("timestamp_ntz")), 2)


@query(f"WITH {_SCORES}, m AS (SELECT asset_key, max(scored_at) AS newest FROM scores GROUP BY 1) SELECT asset_key, scored_at, total FROM scores JOIN m USING (asset_key) WHERE scored_at < TIMESTAMP '1998-01-01' AND scored_at < newest")
def outdated_scores(spark, sf_dir):
    return catalog.outdated(_scores(spark, sf_dir), "scores", F.lit("1998-01-01").cast("timestamp_ntz")).select("asset_key", "scored_at", "total")


@query(f"WITH {_RUNS} SELECT asset_key, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY started_at DESC, run_id) AS k FROM runs) WHERE k <= 10")
def newest_runs(spark, sf_dir):
    return catalog.newest(_runs(spark, sf_dir), ["asset_key"], "started_at", 10, ["run_id"]).select("asset_key", "run_id", "started_at")


# --- reading, exports and scalars ---------------------------------------------------------------------------


@query("SELECT event_id, event_type, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 20)")
def sample_rows(spark, sf_dir):
    return reading.sample(table(spark, sf_dir, "events"), 20, "ts", ["event_id"]).select("event_id", "event_type", "ts")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00' AND event_type IN ('click', 'view') AND value > 20 ORDER BY ts DESC, event_id LIMIT 300")
def fetch_general(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reading.fetch(e, ["event_id", "user_id", "event_type"], "2024-01-03 00:00:00", "2024-01-09 12:00:00", F.col("value") > 20, ["click", "view"], "event_type", "ts", "ts, event_id", True, 300)


@query("SELECT l_shipmode_, round(avg(l_quantity), 4) AS avg_l_quantity, round(max(l_quantity), 4) AS max_l_quantity, round(sum(l_tax), 4) AS sum_l_tax, count(l_tax) AS count_l_tax FROM (SELECT l_linestatus AS l_shipmode_, * FROM lineitem) GROUP BY 1")
def aggregate_by_key(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode_")
    return rounded(reading.aggregate(d, "l_shipmode_", {"l_quantity": ["avg", "max"], "l_tax": ["sum", "count"]}))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return reading.row_count(table(spark, sf_dir, "lineitem"))


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) t(place, name, type)")
def schema_of(spark, sf_dir):
    return reading.schema(table(spark, sf_dir, "region")).select("place", "name", "type")


@query(f"WITH {_DAILY}, l AS (SELECT *, {_EURO.format(c='aqi_avg')} AS level FROM daily) SELECT city_id AS slug, count(*) AS \"统计天数\", count(*) FILTER (aqi_avg <= 30) AS \"优良天\", count(*) FILTER (aqi_avg > 30) AS \"超标天\", round(100.0 * count(*) FILTER (aqi_avg <= 30) / count(*), 2) AS \"优良天比例(%)\", CASE WHEN 100.0 * count(*) FILTER (aqi_avg <= 30) / count(*) >= 80 THEN '是' ELSE '否' END AS \"是否达标\", CAST(sum(exceed_hours) AS BIGINT) AS \"超标小时数\", CAST(sum(obs_hours) AS BIGINT) AS \"有效观测小时数\", round(100.0 * sum(exceed_hours) / sum(obs_hours), 2) AS \"超标小时占比(%)\", count(*) FILTER (level = '良') AS \"良天数\" FROM l GROUP BY 1")
def compliance_export(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.col("city_id").alias("entity"), "date", F.col("aqi_avg").alias("value"), "exceed_hours", "obs_hours")
    t = exports.compliance_table(report.compliance(d, 30.0, S.aqi_level(F.col("value")), S.LEVELS))
    return rounded(t.select("slug", "统计天数", "优良天", "超标天", "优良天比例(%)", "是否达标", "超标小时数", "有效观测小时数", "超标小时占比(%)", "良天数"), 2)


@query(f"WITH {DAYS}, c AS (SELECT entity, 100.0 * count(*) FILTER (value <= 300000) / count(*) AS p FROM d GROUP BY 1) SELECT count(*) AS entities, count(*) FILTER (p >= 80) AS meeting_target, (SELECT entity FROM c ORDER BY p DESC, entity LIMIT 1) AS best, (SELECT entity FROM c ORDER BY p, entity LIMIT 1) AS worst FROM c")
def compliance_totals(spark, sf_dir):
    return report.compliance_totals(report.compliance(days(spark, sf_dir), 3e5, F.lit("x"), ["x"]))


@query(f"WITH {DAYS}, m AS (SELECT entity, avg(value) FILTER (date BETWEEN DATE '2000-02-01' AND DATE '2000-02-29') AS a, avg(value) FILTER (date BETWEEN DATE '1999-02-01' AND DATE '1999-02-28') AS b, count(*) FILTER (date BETWEEN DATE '2000-02-01' AND DATE '2000-02-29') AS na, count(*) FILTER (date BETWEEN DATE '1999-02-01' AND DATE '1999-02-28') AS nb FROM d GROUP BY 1) SELECT entity, round(a, 2) AS current, round(b, 2) AS previous, na AS current_days, nb AS previous_days, round(100.0 * (a - b) / abs(b), 2) AS percent FROM m WHERE na > 0")
def year_period_change(spark, sf_dir):
    return rounded(report.year_period_change(days(spark, sf_dir), "2000-02-29", 29).select("entity", "current", "previous", "current_days", "previous_days", "percent"), 2)


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug, regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_]*$') AS identifier, contains(lower(p_name), 'ring') AS ring, replace(p_brand, '#', '%23') AS url, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 6) AS tail FROM part")
def text_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tail = F.element_at(F.split(scalars.run_id("run", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("p_partkey")), "-"), -1)
    return p.select("p_partkey", scalars.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), scalars.is_identifier(F.col("p_brand")).alias("identifier"), scalars.contains_text(F.col("p_name"), " RING ").alias("ring"), scalars.url_part(F.col("p_brand")).alias("url"), tail.alias("tail"))


@query("SELECT o_orderkey, date_trunc('hour', o_orderdate + to_minutes(o_orderkey % 1440)) AS h, greatest(0, CAST(date_diff('second', o_orderdate, o_orderdate + to_minutes(o_orderkey % 1440 - 300)) AS BIGINT) // 3600) AS hours, CAST(date_diff('month', o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 90 AS INT))) + 1 AS INT) AS months, CAST(o_orderkey % 90 + 1 AS INT) AS days, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, o_orderdate AS parsed, CASE WHEN o_orderkey % 1440 = 0 THEN 'just now' WHEN o_orderkey % 1440 < 60 THEN (o_orderkey % 1440) || ' min ago' ELSE (o_orderkey % 1440 // 60) || ' h ago' END AS ago FROM orders")
def time_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"m": (F.col("o_orderkey") % 1440).cast("int"), "n": (F.col("o_orderkey") % 90).cast("int")})
    later, d = F.col("o_orderdate") + F.make_dt_interval(mins=F.col("m")), F.col("o_orderdate").cast("date")
    shifted = F.col("o_orderdate") + F.make_dt_interval(mins=F.col("m") - 300)
    return o.select("o_orderkey", scalars.floor_hour(later).alias("h"), scalars.hours_between(F.col("o_orderdate"), shifted).alias("hours"), F.size(scalars.months_of(d, F.date_add(d, F.col("n")))).alias("months"), F.size(scalars.days_of(d, F.date_add(d, F.col("n")))).alias("days"), scalars.iso_z(F.col("o_orderdate")).alias("iso"), scalars.parse_time(scalars.iso_z(F.col("o_orderdate"))).alias("parsed"), scalars.relative_time(F.col("o_orderdate"), later).alias("ago"))


@query("WITH a AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, CAST(ceil(n / 3.0) AS INT) AS n_chunks, CAST(len(list_distinct(l)) AS INT) AS n_unique, array_to_string(l[1:2], '|') AS first_two, CAST(len(list_filter(l, lambda x: x = '1-URGENT')) AS INT) AS urgent FROM a")
def collection_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("l"))  # orders of a customer
    counts = F.map_from_entries(F.transform(F.array_distinct("l"), lambda k: F.struct(k, F.size(F.filter("l", lambda x: x == k)))))
    urgent = F.element_at(scalars.zero_filled(scalars.merged(F.create_map(F.lit("9-NONE"), F.lit(0)), counts), ["1-URGENT", "9-NONE"]), "1-URGENT")
    return o.select("o_custkey", F.size(scalars.chunks(F.col("l"), 3)).alias("n_chunks"), F.size(scalars.unique(F.col("l"))).alias("n_unique"), F.array_join(scalars.first_k(F.col("l"), 2), "|").alias("first_two"), urgent.alias("urgent"))


# --- statistics and reports ----------------------------------------------------------------------------------

_FLAGS = "x AS (SELECT l_returnflag AS flag, l_quantity AS v, 'l_quantity' AS metric FROM lineitem UNION ALL SELECT l_returnflag, l_extendedprice, 'l_extendedprice' FROM lineitem), y AS (SELECT flag AS entity, metric, v FROM x UNION ALL SELECT NULL, metric, v FROM x)"


@query(f"WITH {_FLAGS}, q AS (SELECT entity, metric, count(*) AS count, avg(v) AS mean, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS q3 FROM y GROUP BY 1, 2) SELECT q.entity, q.metric, any_value(count) AS count, round(any_value(mean), 2) AS mean, round(any_value(q1), 2) AS q1, round(any_value(p50), 2) AS p50, round(any_value(q3), 2) AS q3, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 2) AS high_whisker, count(*) FILTER (v > q3 + 1.5 * (q3 - q1) OR v < q1 - 1.5 * (q3 - q1)) AS n_outliers FROM y JOIN q ON q.metric = y.metric AND q.entity IS NOT DISTINCT FROM y.entity GROUP BY 1, 2")
def distribution(spark, sf_dir):
    d = stats.distribution(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return rounded(d.select("entity", "metric", "count", "mean", "q1", "p50", "q3", "high_whisker", "n_outliers"), 2)


_FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RANKED = "r AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _FOUR) + " FROM lineitem)"


@query(f"WITH {_RANKED} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 4) AS pearson, round(corr(r_{a}, r_{b}), 4) AS spearman FROM r" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return rounded(stats.correlation_matrix(table(spark, sf_dir, "lineitem"), _FOUR))


@query("""WITH x AS (SELECT l_returnflag AS entity, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT NULL, l_quantity, l_extendedprice FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY x) + (count(*) OVER (PARTITION BY entity, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY entity ORDER BY y) + (count(*) OVER (PARTITION BY entity, y) - 1) / 2.0 AS ry FROM x),
c AS (SELECT entity, count(*) AS samples, corr(x, y) AS p, corr(rx, ry) AS s, regr_slope(y, x) AS slope FROM r GROUP BY 1) SELECT entity, samples, round(p, 4) AS pearson, round(s, 4) AS spearman, round(slope, 2) AS slope, CASE WHEN abs(p) < 0.2 THEN '几乎无' ELSE CASE WHEN abs(p) >= 0.8 THEN '极强' WHEN abs(p) >= 0.6 THEN '强' WHEN abs(p) >= 0.4 THEN '中等' ELSE '弱' END || CASE WHEN p > 0 THEN '正' ELSE '负' END || '相关' END AS pearson_label, 'price ' || CASE WHEN p > 0 THEN 'rises' ELSE 'falls' END || ' with quantity' AS said FROM c""")
def relationship(spark, sf_dir):
    d = stats.relationship(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    said = F.element_at(F.split(stats.interpretation(F.col("pearson"), F.col("spearman"), "quantity", "price"), ":"), 1)
    d = rounded(d.select("entity", "samples", "pearson", "spearman", "slope", "pearson_label", said.alias("said")))
    return d.withColumn("slope", F.round("slope", 2))


@query("""WITH z AS (SELECT event_type, event_id, value, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)) SELECT event_type, count(*) AS samples, count(*) FILTER (abs(z) > 3) AS flagged, round(ROUND(100.0 * count(*) FILTER (abs(z) > 3) / count(*), 3), 3) AS flagged_percent, round(avg(value), 3) AS mean, round(max(abs(z)), 3) AS max_z FROM z GROUP BY 1""")
def outlier_report(spark, sf_dir):
    d = stats.outlier_report(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "value", ["event_type"])
    return rounded(d.drop("std"), 3)


@query("""WITH z AS (SELECT event_type, event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(z) DESC, event_id) AS place FROM z WHERE abs(z) > 3) SELECT event_type, event_id, round(z, 4) AS z FROM k WHERE place <= 60 ORDER BY abs(k.z) DESC, event_type, event_id LIMIT 200""")
def top_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(stats.outliers(e, "value", ["event_type"], total=200).select("event_type", "event_id", "z"))


@query("WITH c AS (SELECT 'l_shipdate' AS \"column\", strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS value, count(*) AS count FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem GROUP BY 2), k AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS n FROM c) SELECT \"column\", value, count FROM k WHERE n <= 5")
def top_values(spark, sf_dir):
    return stats.top_values(table(spark, sf_dir, "lineitem"), ["l_shipdate", "l_returnflag"])


@query(f"WITH {DAYS}, m AS (SELECT entity, avg(value) FILTER (CAST(replace(entity, 'NATION_', '') AS INT) % 4 <> 0) AS a, max(value) AS b FROM d GROUP BY 1) SELECT entity, round(coalesce(a, avg(a) OVER ()), 2) AS a, round(b, 2) AS b FROM m")
def imputed_features(spark, sf_dir):
    m = days(spark, sf_dir).groupBy("entity").agg(F.avg(F.when(F.expr("CAST(replace(entity, 'NATION_', '') AS INT) % 4 <> 0"), F.col("value"))).alias("a"), F.max("value").alias("b"))
    return rounded(stats.imputed(m, ["a", "b"]), 2)


@query()
def cluster_choice(spark, sf_dir):
    return rounded(similar.choose_k(features(spark, sf_dir), 2, 3, restarts=2))


@query()
def cluster_report(spark, sf_dir):
    f = features(spark, sf_dir)
    return similar.cluster_report(f, similar.cluster(f, 3, restarts=3), ["a", "b"])


# --- sources and jobs ------------------------------------------------------------------------------------------


@query("SELECT n_name AS city_id, '/v1/archive' AS path, CAST(n_nationkey AS DOUBLE) AS lat, '2024-01-01' AS start_date, '2024-01-15' AS end_date, CASE WHEN n_nationkey % 2 = 0 THEN 'UTC' ELSE 'Asia/Tokyo' END AS timezone FROM nation")
def archive_requests(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city_id"), F.col("n_nationkey").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.when(F.col("n_nationkey") % 2 == 1, "Asia/Tokyo").alias("timezone"))
    p = lambda k: F.element_at("params", k)
    d = endpoints.requests(n, "archive", "2024-01-20", start="2024-01-01", end="2024-01-31")
    return d.select("city_id", "path", p("latitude").cast("double").alias("lat"), p("start_date").alias("start_date"), p("end_date").alias("end_date"), p("timezone").alias("timezone"))


_ANSWER = """CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 10 = 4 THEN '{"hourly": {"nothing": [1]}}' ELSE '{"hourly": {"time": ["2024-01-20T10:00", "2024-01-20T14:00"], "pm2_5": [' || c_custkey || ']}}' END"""


@query("SELECT 'c' || c_custkey AS city_id, CASE WHEN c_custkey % 10 IN (3, 4) THEN 0 ELSE 2 END AS rows, CASE WHEN c_custkey % 10 IN (3, 4) THEN 'failed' ELSE 'success' END AS status, CASE WHEN c_custkey % 10 IN (3, 4) THEN 0 ELSE 1 END AS forecasts, CASE c_custkey % 10 WHEN 3 THEN 0 WHEN 4 THEN 30 ELSE 29 END AS n_missing FROM customer")
def collected_outcomes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("city_id"), F.expr(_ANSWER).alias("body"), F.when(F.col("c_custkey") % 10 == 3, "timeout").alias("error"))
    clocks = c.select("city_id", F.lit(NOW).cast("timestamp_ntz").alias("local_now"))
    rows, outcomes = jobs.collected(c, clocks, {"pm2_5": "double"}, "air_quality")
    f = rows.groupBy("city_id").agg(F.sum("is_forecast").alias("forecasts"))
    return outcomes.join(f, "city_id", "left").select("city_id", F.col("rows").cast("int").alias("rows"), "status", F.coalesce("forecasts", F.lit(0)).cast("int").alias("forecasts"), F.size("missing").alias("n_missing"))


@query(f"WITH {HOURS} SELECT entity, time, round(value, 4) AS value, CAST(row_number() OVER (ORDER BY value DESC, entity, time) AS INT) AS place FROM h")
def ranked_hours(spark, sf_dir):
    return rounded(patterns.ranked(hours(spark, sf_dir), "value", [F.col("entity").asc(), F.col("time").asc()], "place"))


@query("SELECT s_suppkey AS k, CASE WHEN c.v IS NULL THEN 'create' WHEN c.v = s_nationkey THEN 'keep' ELSE 'update' END AS action FROM supplier LEFT JOIN (SELECT s_suppkey AS k, s_nationkey + s_suppkey % 2 AS v FROM supplier WHERE s_suppkey % 3 <> 0) c ON k = s_suppkey")
def config_sync(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return joins.sync(s.where("k % 3 <> 0").withColumn("v", F.col("v") + F.col("k") % 2), s, ["k"], "v").select("k", "action")


# --- the lake -----------------------------------------------------------------------------------------------------

_EVENTS = lake.Asset("events", {"city_id": "string", "time": "timestamp", "event": "integer", "value": "double"}, ("city_id", "event"))


def _scratch(spark: SparkSession) -> str:
    """A folder of its own where the cluster shares files; a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(base or Path(tempfile.mkdtemp(prefix='lake-')).as_uri()).rstrip('/')}/lake-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the application ends; the session may be gone then."""
    with suppress(Exception):
        fs, p = lake._fs(spark, path)
        fs.delete(p, True)


def _upserted(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A lake of the events, written in two overlapping batches of which the second one changes values."""
    root = _scratch(spark)
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id") % 2).alias("city_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_id").alias("event"), F.col("value").cast("string").alias("value"), F.lit(1).alias("extra"))
    lake.upsert(e.where("event % 3 <> 0"), root, _EVENTS)
    return root, lake.upsert(e.where("event % 2 = 0").withColumn("value", F.when(F.col("event") % 4 == 0, "not a number").otherwise(F.col("value"))).drop("extra"), root, _EVENTS)


@query("WITH l AS (SELECT event_type || '/' || (user_id % 2) AS city_id, ts, event_id AS event, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0) SELECT city_id, count(*) AS n, count(value) AS known, round(sum(value), 4) AS total, CAST(sum(event) AS BIGINT) AS events FROM l GROUP BY 1")
def lake_upsert(spark, sf_dir):
    root, _ = _upserted(spark, sf_dir)
    return rounded(lake.scan(spark, root, _EVENTS).groupBy("city_id").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.sum("value").alias("total"), F.sum("event").alias("events")))


@query("WITH a AS (SELECT event_id, event_type || '/' || (user_id % 2) AS city FROM events) SELECT 'events' AS asset_key, count(*) FILTER (event_id % 2 = 0) AS rows_received, count(*) FILTER (event_id % 3 <> 0 OR event_id % 2 = 0) AS rows_written, count(*) FILTER (event_id % 3 <> 0 AND event_id % 2 = 0) AS duplicates_removed, CAST(count(DISTINCT city) FILTER (event_id % 2 = 0) AS INT) AS partitions_written, 0 AS n_missing FROM a")
def lake_report(spark, sf_dir):
    return _upserted(spark, sf_dir)[1].select("asset_key", "rows_received", "rows_written", "duplicates_removed", "partitions_written", F.size("missing_columns").alias("n_missing"))


@query("SELECT 'events' AS asset_key, count(*) AS row_count, count(DISTINCT event_type || '/' || (user_id % 2)) AS city_count, date_trunc('second', min(ts)) AS earliest_data_time, date_trunc('second', max(ts)) AS latest_data_time FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0")
def dataset_stats(spark, sf_dir):
    root, _ = _upserted(spark, sf_dir)
    return lake.dataset_stats(spark, root, _EVENTS).select("asset_key", "row_count", "city_count", "earliest_data_time", "latest_data_time")


@query("SELECT event_id AS event, round(value, 4) AS value FROM events WHERE event_type = 'click' AND user_id % 2 = 1 AND event_id % 3 <> 0 AND event_id % 2 <> 0 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 23:59:59'")
def lake_scan(spark, sf_dir):
    root, _ = _upserted(spark, sf_dir)
    d = lake.scan(spark, root, _EVENTS, ["click/1"], "2024-01-05", "2024-01-06T23:59:59")
    return rounded(d.where("event % 2 <> 0").select("event", "value"))


@query("WITH f AS (SELECT user_id AS city_id, date_trunc('hour', ts) AS time, max(value) AS t, 1 AS is_forecast FROM events WHERE event_type = 'click' GROUP BY 1, 2), a AS (SELECT user_id AS city_id, date_trunc('hour', ts) AS time, max(value) AS t, min(value) AS w FROM events WHERE event_type = 'view' GROUP BY 1, 2), x AS (SELECT user_id AS city_id, date_trunc('hour', ts) AS time, max(value) AS p FROM events WHERE event_type = 'error' GROUP BY 1, 2), fa AS (SELECT city_id, time, coalesce(f.t, a.t) AS t, w, coalesce(is_forecast, 0) AS is_forecast FROM f FULL JOIN a USING (city_id, time)) SELECT city_id, time, round(coalesce(t, -1), 4) AS t, round(coalesce(w, -1), 4) AS w, round(coalesce(p, -1), 4) AS p, coalesce(is_forecast, -1) AS is_forecast FROM fa FULL JOIN x USING (city_id, time)")
def fuse_three(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("city_id"), scalars.floor_hour(F.col("ts")).alias("time"), "event_type", "value")
    side = lambda kind, *aggs: e.where(F.col("event_type") == kind).groupBy("city_id", "time").agg(*aggs)
    f = side("click", F.max("value").alias("t")).withColumn("is_forecast", F.lit(1))
    d = derive.fused(f, side("view", F.max("value").alias("t"), F.min("value").alias("w")), side("error", F.max("value").alias("p")))
    return rounded(d.fillna(-1, ["t", "w", "p", "is_forecast"]).select("city_id", "time", "t", "w", "p", "is_forecast"))


@query("SELECT * FROM (VALUES (0, 'distribution', '统计与分布', '描述性分析', 'hourly'), (1, 'correlation', '指标相关性', '描述性分析', 'hourly'), (2, 'hourly-profile', '日内规律画像', '时段规律', 'hourly'), (3, 'weekly-profile', '周内规律画像', '时段规律', 'daily'), (4, 'monthly-trend', '月度趋势', '时段规律', 'daily'), (5, 'outliers', '异常点检测', '异常与过程', 'hourly'), (6, 'episodes', '污染过程识别', '异常与过程', 'hourly'), (7, 'relationship', '气象—空气质量关系', '归因分析', 'hourly'), (8, 'compliance', '达标考核', '考核与报表', 'daily'), (9, 'comparison', '环比与同比', '考核与报表', 'daily'), (10, 'clustering', '城市聚类与相似度', '横向对比', 'hourly')) t(place, key, name, category, needs)")
def insight_catalog(spark, sf_dir):
    return insights.catalog(spark)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"hourly": hourly(spark, sf_dir).withColumn("china_aqi", F.col("value")), "daily": daily(spark, sf_dir).withColumn("china_aqi", F.col("aqi_avg"))}


@query(f"WITH {_DAILY}, {_CITIES}, c AS (SELECT city_id, 100.0 * count(*) FILTER (aqi_avg <= 100) / count(*) AS p FROM daily WHERE city_id IN (SELECT city_id FROM cities WHERE active) AND date BETWEEN DATE '2024-01-20' - 30 AND DATE '2024-01-20' GROUP BY 1), t AS (SELECT 100.0 * count(*) FILTER (aqi_avg <= 100) / count(*) AS p, avg(aqi_avg) AS m, count(*) AS n FROM daily WHERE city_id IN (SELECT city_id FROM c) AND date BETWEEN DATE '2024-01-20' - 30 AND DATE '2024-01-20'), hm AS (SELECT city_id, hour(time) AS k, avg(value) AS m FROM env WHERE time >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND city_id IN (SELECT city_id FROM c) GROUP BY 1, 2), w AS (SELECT city_id, max(m) - min(m) AS a FROM hm GROUP BY 1) SELECT round(p, 2) AS good_percent, round(m, 2) AS aqi_avg, n AS days, (SELECT city_id FROM c ORDER BY p DESC, city_id LIMIT 1) AS best_city, (SELECT city_id FROM c ORDER BY p, city_id LIMIT 1) AS worst_city, (SELECT city_id FROM w ORDER BY a DESC, city_id LIMIT 1) AS most_volatile FROM t")
def digest(spark, sf_dir):
    d = insights.digest(_tables(spark, sf_dir), cities(spark, sf_dir), NOW)
    return rounded(d.select("good_percent", "aqi_avg", "days", "best_city", "worst_city", "most_volatile"), 2)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 10")
def distinct_keys(spark, sf_dir):
    d = reading.sql(spark, "SELECT * FROM {lines} WHERE l_quantity > :least", {"lines": table(spark, sf_dir, "lineitem")}, least=10)
    return reading.distinct(d, "l_returnflag", "l_linestatus")


@query("SELECT event_type || '/' || (user_id % 2) AS city, count(DISTINCT strftime(ts, '%Y-%m')) AS partitions, count(DISTINCT strftime(ts, '%Y-%m')) AS files FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY 1")
def partition_summary(spark, sf_dir):
    root, _ = _upserted(spark, sf_dir)
    d = lake.partitions(spark, root, _EVENTS)
    return d.groupBy("city").agg(F.count_distinct("year", "month").alias("partitions"), F.count("*").alias("files"))


@query(f"WITH {_RUNS}, {_SCORES}, {_RESULTS}, m AS (SELECT asset_key, max(scored_at) AS newest FROM scores GROUP BY 1) SELECT 'runs' AS \"table\", count(*) AS rows, count(*) FILTER (started_at < TIMESTAMP '{_LAST_DAY}' - INTERVAL 90 DAY) AS pruned FROM runs UNION ALL SELECT 'results', count(*), count(*) FILTER (evaluated_at < TIMESTAMP '{_LAST_DAY}' - INTERVAL 90 DAY) FROM results UNION ALL SELECT 'scores', count(*), count(*) FILTER (scored_at < TIMESTAMP '{_LAST_DAY}' - INTERVAL 90 DAY AND scored_at < newest) FROM scores JOIN m USING (asset_key) UNION ALL SELECT 'runs left', count(*), 0 FROM runs WHERE started_at >= TIMESTAMP '{_LAST_DAY}' - INTERVAL 90 DAY")
def catalog_prune(spark, sf_dir):
    root = _scratch(spark)
    for name, d in (("runs", _runs(spark, sf_dir)), ("results", _results(spark, sf_dir)), ("scores", _scores(spark, sf_dir))):
        catalog.append(d, root, name)
    report = catalog.prune(spark, root, _LAST_DAY, 90, dry_run=False)
    left = catalog.read(spark, root, "runs").agg(F.count("*").alias("rows")).select(F.lit("runs left").alias("table"), "rows", F.lit(0).cast("bigint").alias("pruned"))
    return report.unionAll(left)


@query("SELECT event_type AS city_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_ingest(spark, sf_dir):
    root = _scratch(spark)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("city_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_id").alias("event"), "value")
    e.write.json(f"{root}/arrived")
    ingest.ingest(spark, f"{root}/arrived", f"{root}/lake", _EVENTS, f"{root}/checkpoint").awaitTermination()
    return rounded(lake.scan(spark, f"{root}/lake", _EVENTS).groupBy("city_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
