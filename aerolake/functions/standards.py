"""Domain functions as column expressions: indices, levels, loads, comfort, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# European index bands (upper bound included) and the levels.
LEVELS = ["优", "良", "轻度污染", "中度污染", "重度污染", "严重污染"]
EAQI_BOUNDS = [20.0, 40.0, 60.0, 80.0, 100.0]
CHINA_BOUNDS = [50.0, 100.0, 150.0, 200.0, 300.0]
# Load breakpoints, in the order that decides ties.
LOAD_POINTS = {
    "pm2_5": [35, 75, 115, 150, 250],
    "pm10": [50, 150, 250, 350, 420],
    "ozone": [100, 160, 215, 265, 800],
    "nitrogen_dioxide": [40, 80, 180, 280, 565],
    "sulphur_dioxide": [50, 150, 475, 800, 1600],
    "carbon_monoxide": [2000, 4000, 14000, 24000, 36000],
}
# Index scale and breakpoints, in the order that decides ties; CO in mg per cubic metre.
IAQI_SCALE = [0, 50, 100, 150, 200, 300, 400, 500]
IAQI_POINTS = {
    "pm2_5": [0, 35, 75, 115, 150, 250, 350, 500],
    "pm10": [0, 50, 150, 250, 350, 420, 500, 600],
    "sulphur_dioxide": [0, 50, 150, 475, 800, 1600, 2100, 2620],
    "nitrogen_dioxide": [0, 40, 80, 180, 280, 565, 750, 940],
    "carbon_monoxide": [0, 2, 4, 14, 24, 36, 48, 60],
    "ozone": [0, 100, 160, 215, 265, 800, 800, 800],
}
LABELS = {"pm2_5": "PM2.5", "pm10": "PM10", "ozone": "O₃", "nitrogen_dioxide": "NO₂", "sulphur_dioxide": "SO₂", "carbon_monoxide": "CO"}
NONE = "无"
# Weather codes.
WEATHER = {0: "晴", 1: "晴间多云", 2: "多云", 3: "阴", 45: "雾", 48: "雾凇", 51: "毛毛雨（弱）", 53: "毛毛雨（中）", 55: "毛毛雨（强）", 56: "冻毛毛雨（弱）", 57: "冻毛毛雨（强）", 61: "小雨", 63: "中雨", 65: "大雨", 66: "冻雨（弱）", 67: "冻雨（强）", 71: "小雪", 73: "中雪", 75: "大雪", 77: "米雪", 80: "阵雨（弱）", 81: "阵雨（中）", 82: "阵雨（强）", 85: "阵雪（弱）", 86: "阵雪（强）", 95: "雷阵雨", 96: "雷阵雨伴小冰雹", 99: "雷阵雨伴强冰雹"}
# Alert rules (key, metric, operator, threshold, severity).
ALERTS = [
    ("air.severe_pollution", "european_aqi", ">=", 100.0, "severe"),
    ("air.heavy_pollution", "european_aqi", ">=", 80.0, "severe"),
    ("air.moderate_pollution", "european_aqi", ">=", 60.0, "warning"),
    ("air.light_pollution", "european_aqi", ">=", 40.0, "info"),
    ("weather.heat_wave", "temperature_2m", ">=", 35.0, "severe"),
    ("weather.heat_warning", "temperature_2m", ">=", 32.0, "warning"),
    ("weather.frost", "temperature_2m", "<=", -10.0, "severe"),
    ("weather.gale", "wind_speed_10m", ">=", 50.0, "warning"),
    ("weather.strong_gust", "wind_gusts_10m", ">=", 75.0, "warning"),
    ("weather.heavy_rain", "precipitation", ">=", 8.0, "severe"),
    ("weather.low_visibility", "visibility", "<=", 1000.0, "warning"),
    ("weather.high_uv", "uv_index", ">=", 8.0, "info"),
]
SEVERITIES = ["severe", "warning", "info"]
# Colours of the levels and of no level, and health advice by level for either index.
COLORS = dict(zip(LEVELS, ["#00e400", "#ffff00", "#ff7e00", "#ff0000", "#99004c", "#7e0023"], strict=True))
NO_COLOR = "#94a3b8"
ADVICE = {
    "优": "空气质量令人满意，可正常户外活动。",
    "良": "空气质量可接受，极少数敏感人群应减少户外剧烈运动。",
    "轻度污染": "易感人群症状轻度加剧，儿童、老年人及心肺疾病患者应减少长时间户外活动。",
    "中度污染": "进一步加剧易感人群症状，建议疾病患者避免长时间户外活动，一般人群适量减少户外运动。",
    "重度污染": "心脏病和肺病患者症状显著加剧，建议儿童、老年人和心脏病、肺病患者停留在室内，停止户外运动。",
    "严重污染": "健康人群运动耐受力降低，建议儿童、老年人和病人留在室内，避免体力消耗，一般人群应避免户外活动。",
}
CHINA_ADVICE = {
    "优": "空气质量令人满意，基本无空气污染，各类人群可正常活动。",
    "良": "空气质量可接受，极少数异常敏感人群应减少户外活动。",
    "轻度污染": "易感人群症状有轻度加剧，儿童、老年人及心脏病、呼吸系统疾病患者应减少长时间、高强度的户外锻炼。",
    "中度污染": "进一步加剧易感人群症状，建议疾病患者避免长时间、高强度的户外锻炼，一般人群适量减少户外运动。",
    "重度污染": "心脏病和肺病患者症状显著加剧，建议儿童、老年人和心脏病、肺病患者应停留在室内，停止户外运动。",
    "严重污染": "健康人群运动耐受力降低，有明显强烈症状，建议儿童、老年人和病人应当留在室内，避免体力消耗，一般人群应避免户外活动。",
}
# Grades of an episode with their least points, and strengths of a correlation with their least size.
EPISODE_GRADES = [(50, "严重"), (35, "较重"), (22, "中等"), (0, "轻微")]
STRENGTHS = [(0.8, "极强"), (0.6, "强"), (0.4, "中等"), (0.2, "弱")]
NO_STRENGTH, TOO_FEW, POSITIVE, NEGATIVE, CORRELATED = "几乎无", "样本不足", "正", "负", "相关"


def clean(v: Column) -> Column:
    """NaN becomes null, as missing values are stored."""
    return F.when(~F.isnan(v), v)


def _banded(v: Column, bounds: list[float], values: list) -> Column:
    out = F.when(v.isNull() | F.isnan(v), None)
    for b, x in zip(bounds, values, strict=False):
        out = out.when(v <= b, x)
    return out.otherwise(values[-1])


def aqi_level(v: Column) -> Column:
    return _banded(v, EAQI_BOUNDS, LEVELS)


def aqi_level_index(v: Column) -> Column:
    return _banded(v, EAQI_BOUNDS, list(range(1, 7))).cast("int")


def china_aqi_level(v: Column) -> Column:
    return _banded(v, CHINA_BOUNDS, LEVELS)


def _pieces(v: Column, ends: list[float], lines: list[Column]) -> Column:
    """The line of the first end that v doesn't exceed; nothing beyond the last."""
    out = None
    for end, line in zip(ends, lines, strict=True):
        out = F.when(v <= end, line) if out is None else out.when(v <= end, line)
    return out


def pollutant_load(v: Column, pollutant: str) -> Column:
    """Position among the breakpoints: piecewise linear, 6 above the last, null if negative."""
    ends = LOAD_POINTS[pollutant]
    lines = [i + (v - lo) / (hi - lo) for i, (lo, hi) in enumerate(zip([0.0, *ends[:-1]], ends, strict=True))]
    return F.when(~F.isnan(v) & (v >= 0), F.coalesce(_pieces(v, ends, lines), F.lit(float(len(ends) + 1))))


def compilable(df: DataFrame) -> DataFrame:
    """df in a session that has no method beyond 8,000 bytes generated: the JVM compiles none of those but interprets
    them, some five times as slow. Expressions of many break points are split into smaller methods then."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(df.sparkSession.conf.get(key)) > 8000:
        df.sparkSession.conf.set(key, "8000")
    return df


def _best(values: list[Column]) -> Column:
    """struct(value, place): the largest value and the place of the first that has it; place is negative. Evaluated
    once where a projection keeps it as a column, which Catalyst doesn't inline into its several uses."""
    return F.array_max(F.array(*(F.struct(v.cast("double").alias("value"), F.lit(-i).alias("place")) for i, v in enumerate(values))))


def _named(best: Column, names: list[str], least: float) -> Column:
    label = F.get(F.lit([LABELS[k] for k in names]), -best["place"])
    return F.when(best["value"] > least, label).otherwise(NONE)


def _once(best: Column, use) -> Column:
    """use(best) with best evaluated once for a row."""
    return F.get(F.transform(F.array(best), use), 0)


def best_load(columns: dict[str, Column]) -> Column:
    return _best([pollutant_load(columns[k], k) for k in LOAD_POINTS if k in columns])


def primary_of(best: Column, columns: dict[str, Column] | list[str]) -> Column:
    """The pollutant of the largest load (``best_load``) if that is over half of the first limit."""
    return _named(best, [k for k in LOAD_POINTS if k in columns], 0.5)


def primary_pollutant(columns: dict[str, Column]) -> Column:
    return _once(best_load(columns), lambda b: primary_of(b, columns))


def iaqi(v: Column, pollutant: str) -> Column:
    """Sub-index by linear interpolation, 500 from the last breakpoint on, rounded to 2 digits."""
    x = v / 1000.0 if pollutant == "carbon_monoxide" else v
    # Segments without a width are only reached by the end of the one before.
    parts = [(lo, hi, a, b) for lo, hi, a, b in zip(IAQI_POINTS[pollutant], IAQI_POINTS[pollutant][1:], IAQI_SCALE, IAQI_SCALE[1:], strict=False) if hi > lo]
    line = _pieces(x, [p[1] for p in parts], [a + (x - lo) / (hi - lo) * (b - a) for lo, hi, a, b in parts])
    return F.when(~F.isnan(v) & (v >= 0), F.when(x >= IAQI_POINTS[pollutant][-1], 500.0).otherwise(F.round(line, 2)))


def best_iaqi(columns: dict[str, Column]) -> Column:
    return _best([iaqi(columns[k], k) for k in IAQI_POINTS if k in columns])


def china_of(best: Column, columns: dict[str, Column] | list[str]) -> Column:
    """struct(aqi, level, primary) of ``best_iaqi``: the pollutant is named if its sub-index is over 50."""
    return F.struct(best["value"].alias("aqi"), F.coalesce(china_aqi_level(best["value"]), F.lit("")).alias("level"), _named(best, [k for k in IAQI_POINTS if k in columns], 50).alias("primary"))


def china_aqi(columns: dict[str, Column]) -> Column:
    return _once(best_iaqi(columns), lambda b: china_of(b, columns))


def comfort_index(t: Column, humidity: Column, wind: Column) -> Column:
    """Comfort of 0 to 100 from a temperature-humidity index with a wind correction."""
    h, w = F.coalesce(clean(humidity), F.lit(55.0)), F.coalesce(clean(wind), F.lit(0.0))
    f = clean(t) * 1.8
    base = 100.0 - F.abs(f + 32 - (0.55 - 0.0055 * h) * (f - 26) - 70.0) * 3.2
    moved = base + F.when(w <= 20, 3.0).when(w > 40, -F.least(F.lit(18.0), (w - 40) * 0.45)).otherwise(0.0)
    return F.when(f.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), moved)), 2))


def ventilation_index(wind: Column, height: float = 600.0) -> Column:
    w = clean(wind)
    return F.when(w.isNotNull(), F.round(F.greatest(F.lit(0.0), w) / 3.6 * height, 2))


def is_stagnant(wind: Column, rain: Column) -> Column:
    w = clean(wind)
    return F.when(w.isNotNull(), ((w < 8.0) & (F.coalesce(clean(rain), F.lit(0.0)) < 0.1)).cast("int"))


def weather_label(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEATHER.items() for x in kv]), code.cast("int")), F.lit("未知"))


def alerts(columns: dict[str, Column]) -> Column:
    """array of struct(key, metric, value, threshold, severity): of each metric the gravest rule that
    fires (then the strictest), by severity."""
    by_metric: dict[str, list] = {}
    for rule in ALERTS:
        if rule[1] in columns:
            by_metric.setdefault(rule[1], []).append(rule)
    found = []
    for metric, rules in by_metric.items():
        v = columns[metric].cast("double")
        rules = sorted(rules, key=lambda r: (SEVERITIES.index(r[4]), -r[3] if r[2] == ">=" else r[3]))
        out = None
        for key, _, op, limit, severity in rules:
            hit = ~F.isnan(v) & ((v >= limit) if op == ">=" else (v <= limit))
            row = F.struct(F.lit(SEVERITIES.index(severity)).alias("rank"), F.lit(key).alias("key"), F.lit(metric).alias("metric"), F.round(v, 2).alias("value"), F.lit(limit).alias("threshold"), F.lit(severity).alias("severity"))
            out = F.when(hit, row) if out is None else out.when(hit, row)
        found.append(out)
    some = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.transform(some, lambda x: F.struct(*(x[c].alias(c) for c in ("key", "metric", "value", "threshold", "severity"))))


def level_rank(level: Column) -> Column:
    """0 for the best level; an unknown one counts as the best."""
    return F.greatest(F.array_position(F.lit(LEVELS), level).cast("int") - 1, F.lit(0))


def severity(peak: Column, hours: Column) -> Column:
    """Grade of an episode: ten points a level of its peak and one an hour up to a day."""
    points, out = 10 * F.coalesce(level_rank(china_aqi_level(peak)), F.lit(0)) + F.least(hours, F.lit(24)), None
    for least, grade in EPISODE_GRADES:
        out = F.when(points >= least, grade) if out is None else out.when(points >= least, grade)
    return out


def _looked_up(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit(""))), F.lit(default))


def aqi_color(v: Column) -> Column:
    return _looked_up(COLORS, aqi_level(v), NO_COLOR)


def advice(level: Column) -> Column:
    return _looked_up(ADVICE, level, "")


def china_advice(level: Column) -> Column:
    return _looked_up(CHINA_ADVICE, level, "")


def correlation_label(r: Column) -> Column:
    """Strength and sign of a correlation in words."""
    out = F.when(r.isNull() | F.isnan(r), TOO_FEW)
    for least, strength in STRENGTHS:
        out = out.when(F.abs(r) >= least, F.concat(F.lit(strength), F.when(r > 0, POSITIVE).otherwise(NEGATIVE), F.lit(CORRELATED)))
    return out.otherwise(NO_STRENGTH)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def clamp(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def linear_score(v: Column, warn: float, fail: float, invert: bool = False) -> Column:
    """100 from ``warn`` on, 0 up to ``fail``, linear between, rounded to 2 digits; inverted: less is better."""
    if invert:
        v, warn, fail = -v, -warn, -fail
    between = F.round(clamp((v - fail) / (warn - fail) * 100), 2) if warn > fail else F.lit(100.0)
    return F.when(v >= warn, 100.0).when(v <= fail, 0.0).when(v.isNotNull(), between)
