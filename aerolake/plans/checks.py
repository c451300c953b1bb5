"""Quality checks compiled from configuration: score, counts and violating rows of every check of a table.

``compile_checks`` turns a table's description (columns with types, ranges, enumerations and keys) and a list of
rules into aggregates. What looks at single rows runs in one scan, by entity; what looks at keys (duplicates, coverage
of time) in one more scan of the key columns. The violating rows of a check are the ``samples`` least by entity
and time, kept by a bounded aggregate that merges, so a table full of violations costs no more than a clean one. A
check whose expressions don't fit, or that fails when it runs, gets a row with status ``error`` and leaves the others alone.

Cases: values that are null aren't judged (but for the null rate); a check without a judged value, without its
columns, or without anything to look at is skipped; rows of an entity without a clock count whatever their times, as
do all rows of a table without a time column; null entities are an entity.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from fnmatch import fnmatch
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from aerolake.functions import standards as S
from aerolake.plans import quality

try:
    import yaml
except ImportError:  # configurations are JSON texts or mappings then
    yaml = None

#: Rates of bad values that cost the first and the last point, and the window, unless the rules say otherwise.
DEFAULTS = {
    "evaluation_window_hours": 168, "null_rate_warn": 0.05, "null_rate_fail": 0.20, "outlier_warn": quality.OUTLIERS[0], "outlier_fail": quality.OUTLIERS[1],
    "inconsistency_warn": quality.INCONSISTENT[0], "inconsistency_fail": quality.INCONSISTENT[1], "duplicate_warn": quality.DUPLICATES[0], "duplicate_fail": quality.DUPLICATES[1],
}
SAMPLE = "struct<time:string,value:string>"
RESULT = "check string, dimension string, severity string, status string, score double, checked bigint, failed bigint, samples array<struct<part:string,entity:string,time:string,value:string>>, message string"


def load(text: str | Mapping[str, Any]) -> Mapping[str, Any]:
    """A configuration from a YAML (or JSON) text; a mapping stays as it is."""
    if isinstance(text, Mapping):
        return text
    return yaml.safe_load(text) if yaml else json.loads(text)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple = ()


@dataclass(frozen=True)
class Asset:
    """A table as the catalog describes it; ``entity`` is the column whose windows and clocks differ."""

    key: str
    entity: str
    time: str | None = None
    daily: bool = False
    sla_minutes: int | None = None
    primary_key: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()

    @staticmethod
    def of(c: Mapping[str, Any]) -> Asset:
        def column(x: Mapping[str, Any]) -> Field:
            low, high = x.get("range") or (None, None)
            return Field(x["name"], x.get("type", "string"), x.get("nullable", True), low, high, tuple(x.get("enum") or ()))

        return Asset(c["key"], c["entity"], c.get("time"), c.get("granularity") == "daily", c.get("sla_freshness_minutes"), tuple(c.get("primary_key") or ()), tuple(map(column, c.get("columns") or ())))


@dataclass(frozen=True)
class Part:
    """Something judged by row: ``bad`` is null where it isn't; ``value`` is what a sample shows."""

    label: str
    bad: Column
    value: Column


@dataclass(frozen=True)
class Compiled:
    """A check ready to run. Its score is a line over the rate of bad values (``rates``) of all parts together, or
    the mean of the parts' (``each``), or, with ``by_entity``, the mean of the entities' own scores."""

    key: str
    dimension: str = "validity"
    severity: str = "major"
    parts: tuple[Part, ...] = ()
    rates: tuple[float, float] = quality.INCONSISTENT
    each: bool = False
    #: The score is a line over the mean of ``own`` (a sum by entity) from rates[0] down to rates[1].
    mean: bool = False
    samples: int = 5
    keys: tuple[str, ...] = ()
    #: By entity: what is checked and failed, the score (null: none of its own), and samples; of rows or, with keys, of
    #: keys with column ``_n`` (rows of the key).
    by_entity: tuple[Column, Column, Column, Column] | None = None
    #: Known without a scan: checked, failed, what the samples show.
    known: tuple[int, int, list[str]] | None = None
    #: Why it doesn't run, and whether that is an error.
    skipped: str | None = None
    error: str | None = None


@dataclass(frozen=True)
class Context:
    asset: Asset
    params: Mapping[str, Any]
    defaults: Mapping[str, Any]
    types: Mapping[str, str]

    def rates(self, name: str) -> tuple[float, float]:
        return float(self.defaults[f"{name}_warn"]), float(self.defaults[f"{name}_fail"])

    def by_asset(self, name: str, fallback: float) -> float:
        """A parameter of this asset from a table by asset."""
        return float((self.params.get(name) or {}).get(self.asset.key, fallback))

    def span(self) -> quality.Span:
        """What coverage looks at: as long as ``span_hours_by_asset`` says, shifted by ``anchor_hours_by_asset``."""
        return quality.Span(self.by_asset("span_hours_by_asset", self.hours), self.by_asset("anchor_hours_by_asset", 0.0), 24.0 if self.asset.daily else 1.0)

    @property
    def hours(self) -> float:
        return float(self.defaults["evaluation_window_hours"])

    def inside(self, span: quality.Span | None = None) -> Column:
        """Whether a row lies in a window of its entity's clock; true without a clock or a time column."""
        if not self.asset.time:
            return F.lit(True)
        low, high = (span or quality.Span(self.hours, 0.0, 24.0 if self.asset.daily else 1.0)).bounds(F.col("local_now"))
        return F.coalesce(F.col(self.asset.time).cast("timestamp_ntz").between(low, high), F.col("local_now").isNull())

    def judged(self, label: str, bad: Column, value: Column) -> Part:
        return Part(label, F.when(self.inside(), bad), value)


class Skip(Exception):  # noqa: N818  not an error: there is nothing to check
    pass


Compiler = Callable[[Context], Compiled]
COMPILERS: dict[str, Compiler] = {}


def compiles(key: str) -> Callable[[Compiler], Compiler]:
    def register(f: Compiler) -> Compiler:
        if key in COMPILERS:
            raise ValueError(f"two compilers for {key}")
        COMPILERS[key] = f
        return f

    return register


def _number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS DOUBLE)")


def _shown(*columns: str) -> Column:
    """Values of a sample as text; numbers with three decimals."""
    one = lambda c: F.coalesce(F.when(_number(c).isNotNull(), F.round(_number(c), 3).cast("decimal(38,3)").cast("string")), F.col(c).cast("string"), F.lit("null"))
    return F.concat_ws(", ", *(one(c) for c in columns))


def _need(c: Context, *columns: str) -> None:
    if missing := [x for x in columns if x not in c.types]:
        raise Skip(f"no column {', '.join(missing)}")


def rule_of(c: Context, key: str, columns: list[str], holds: Column) -> Compiled:
    """A rule between columns that the rows keep for which it is known."""
    _need(c, *columns)
    return Compiled(key, parts=(c.judged("", ~holds, _shown(*columns)),), rates=c.rates("inconsistency"))


@compiles("completeness.null_rate")
def _null_rate(c: Context) -> Compiled:
    needed = [f.name for f in c.asset.fields if not f.nullable and f.name in c.types]
    if not needed:
        raise Skip("no column must be there")
    return Compiled("completeness.null_rate", parts=tuple(c.judged(n, F.col(n).isNull(), F.lit("null")) for n in needed), rates=c.rates("null_rate"), each=True)


@compiles("completeness.obs_hours")
def _observed_hours(c: Context) -> Compiled:
    _need(c, "obs_hours")
    ideal, least = float(c.params.get("ideal_hours", 24)), float(c.params.get("min_acceptable_hours", 20))
    v = F.when(c.inside(), _number("obs_hours"))
    few = F.when(v < least, F.struct(_time(c), _shown("obs_hours").alias("value")))
    # The mean is that of all rows: counts and sums of hours are put together over the entities.
    score = F.sum(v)
    return Compiled("completeness.obs_hours", by_entity=(F.count(v), F.count_if(v < least), score, least_rows(few, 5)), rates=(ideal, least), mean=True)


@compiles("completeness.time_coverage")
def _coverage(c: Context) -> Compiled:
    if not c.asset.time:
        raise Skip("no time column")
    _need(c, c.asset.time)
    span = c.span()
    expected = max(1, int(span.hours / span.step))
    found = F.least(F.count_if(c.inside(span) & F.col(c.asset.time).isNotNull()), F.lit(expected))
    none = F.array().cast(f"array<{SAMPLE}>")
    return Compiled("completeness.time_coverage", keys=(c.asset.time,), by_entity=(F.lit(expected), F.lit(expected) - found, 100.0 * found / expected, none))


@compiles("timeliness.freshness")
def _freshness(c: Context) -> Compiled:
    if not c.asset.time or not c.asset.sla_minutes:
        raise Skip("no time column or no agreed delay")
    _need(c, c.asset.time)
    now = F.date_trunc("day", "local_now").cast("timestamp_ntz") if c.asset.daily else F.col("local_now")
    stamp = F.col(c.asset.time).cast("timestamp_ntz")
    # Of an entity: rows ahead of its clock by more than an hour haven't arrived; they alone are no delay.
    latest, agreed = F.max(F.when(stamp <= now + F.expr("INTERVAL 1 HOUR"), stamp)), c.asset.sla_minutes
    over = F.timestamp_diff("SECOND", latest, F.max(now)) / 60.0 - agreed
    line = S.clamp(100.0 * (1 - over / max(1.0, (float(c.params.get("zero_score_factor", 3.0)) - 1) * agreed)))
    score = F.when(F.max(now).isNotNull(), F.when(F.count(stamp) == 0, 0.0).when(over.isNull() | (over <= 0), 100.0).otherwise(line))
    shown = F.struct(F.date_format(latest, "yyyy-MM-dd HH:mm:ss").alias("time"), F.lit("latest").alias("value"))
    late = F.when(score < 100.0, F.array(shown)).otherwise(F.array().cast(f"array<{SAMPLE}>"))
    return Compiled("timeliness.freshness", by_entity=(F.when(score.isNotNull(), 1).otherwise(0), F.when(score < 100.0, 1).otherwise(0), score, late))


@compiles("validity.range")
def _ranges(c: Context) -> Compiled:
    limited = [f for f in c.asset.fields if f.low is not None and f.name in c.types]
    if not limited:
        raise Skip("no column has a range")
    return Compiled("validity.range", parts=tuple(c.judged(f.name, ~_number(f.name).between(f.low, f.high), _shown(f.name)) for f in limited), rates=c.rates("outlier"), samples=3)


@compiles("validity.enum")
def _enums(c: Context) -> Compiled:
    listed = [f for f in c.asset.fields if f.values and f.name in c.types]
    if not listed:
        raise Skip("no column has listed values")

    def bad(f: Field) -> Column:
        """Lists of numbers are compared as numbers, so 1, 1.0 and '1' are one value; what is no number isn't listed."""
        try:
            return F.when(F.col(f.name).isNotNull(), ~F.coalesce(_number(f.name).isin([float(v) for v in f.values]), F.lit(False)))
        except (TypeError, ValueError):
            return ~F.col(f.name).cast("string").isin([str(v) for v in f.values])

    return Compiled("validity.enum", parts=tuple(c.judged(f.name, bad(f), _shown(f.name)) for f in listed), rates=c.rates("outlier"))


@compiles("validity.type_conformance")
def _types(c: Context) -> Compiled:
    """Known from the schema, without a scan."""
    if not c.asset.fields:
        raise Skip("no column is described")
    bad = [f for f in c.asset.fields if c.types.get(f.name) not in quality.TYPES[f.kind]]
    total = len(c.asset.fields)
    return Compiled("validity.type_conformance", known=(total, len(bad), [f"{f.name}: {f.kind}, {c.types.get(f.name)}" for f in bad[:5]]))


@compiles("consistency.pm25_le_pm10")
def _pm25(c: Context) -> Compiled:
    return rule_of(c, "consistency.pm25_le_pm10", ["pm2_5", "pm10"], _number("pm2_5") <= _number("pm10") * float(c.params.get("tolerance_ratio", 1.05)))


@compiles("consistency.rain_le_precipitation")
def _rain(c: Context) -> Compiled:
    return rule_of(c, "consistency.rain_le_precipitation", ["rain", "precipitation"], _number("rain") <= _number("precipitation") + float(c.params.get("tolerance_mm", 0.1)))


@compiles("consistency.apparent_temp_deviation")
def _apparent(c: Context) -> Compiled:
    near = F.abs(_number("apparent_temperature") - _number("temperature_2m")) <= float(c.params.get("max_deviation_c", 25.0))
    return rule_of(c, "consistency.apparent_temp_deviation", ["apparent_temperature", "temperature_2m"], near)


@compiles("consistency.daily_extremes")
def _extremes(c: Context) -> Compiled:
    pairs = [p for p in quality.EXTREMES if set(p) <= set(c.types)]
    if not pairs:
        raise Skip("no pair of a day's extremes")
    return Compiled("consistency.daily_extremes", parts=tuple(c.judged(f"{lo}>{hi}", ~(_number(lo) <= _number(hi)), _shown(lo, hi)) for lo, hi in pairs), rates=c.rates("inconsistency"))


@compiles("consistency.aqi_matches_level")
def _level(c: Context) -> Compiled:
    level = next((x for x in ("aqi_level", "dominant_aqi_level") if x in c.types), None)
    index = next((x for x in ("european_aqi", "aqi_max", "aqi_avg") if x in c.types), None)
    if not level or not index:
        raise Skip("no index beside a level")
    return rule_of(c, "consistency.aqi_matches_level", [index, level], S.aqi_level(_number(index)) == F.col(level))


@compiles("consistency.rule")
def _rule(c: Context) -> Compiled:
    """Any SQL condition of the configuration: params ``columns`` and ``holds``."""
    return rule_of(c, "consistency.rule", list(c.params["columns"]), F.expr(c.params["holds"]).cast("boolean"))


@compiles("uniqueness.primary_key")
def _unique(c: Context) -> Compiled:
    keys = [k for k in c.asset.primary_key if k != c.asset.entity and k in c.types]
    if not keys:
        raise Skip("no key beside the entity")
    # A key without the time column lies in the window as its rows do, so the window is part of the key.
    inside = c.inside() if c.asset.time in keys else F.lit(True)
    more = inside & (F.col("_n") > 1)
    time = _time(c) if c.asset.time in keys else F.lit(None).cast("string").alias("time")
    shown = F.when(more, F.struct(time, F.concat_ws(", ", *(F.col(k).cast("string") for k in keys if k != c.asset.time), F.concat(F.col("_n"), F.lit(" rows"))).alias("value")))
    counts = F.sum(F.when(inside, F.col("_n")).otherwise(0)), F.sum(F.when(inside, F.col("_n") - 1).otherwise(0))
    return Compiled("uniqueness.primary_key", keys=tuple(keys), by_entity=(*counts, F.lit(None).cast("double"), least_rows(shown, 5)), rates=c.rates("duplicate"))


def _time(c: Context) -> Column:
    t = F.date_format(F.col(c.asset.time).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss") if c.asset.time else F.lit(None).cast("string")
    return t.alias("time")


def least_rows(row: Column, n: int) -> Column:
    """The n least rows that aren't null, in order: a bounded aggregate, whose buffers merge."""
    return InternalFunction.collect_top_k(row, n, True)


def compile_checks(asset: Asset, rules: Mapping[str, Any], types: Mapping[str, str]) -> list[Compiled]:
    """The checks of ``rules`` that apply to the asset. One that can't be compiled says why (``skipped``, ``error``)."""
    defaults = DEFAULTS | dict(rules.get("defaults") or {})
    out = []
    for r in rules["checks"]:
        if not any(fnmatch(asset.key, p) for p in r.get("applies_to", ["*"])):
            continue
        name = r.get("name", r["key"])
        try:
            got = COMPILERS[r["key"]](Context(asset, r.get("params") or {}, defaults, types)) if r["key"] in COMPILERS else Compiled(name, skipped="no such check")
        except Skip as e:
            got = Compiled(name, skipped=str(e))
        except Exception as e:  # noqa: BLE001  whatever is wrong with one rule, the others run
            got = Compiled(name, error=f"{type(e).__name__}: {e}")
        out.append(replace(got, key=name, dimension=r.get("dimension", r["key"].partition(".")[0]), severity=r.get("severity", "major")))
    return out


def _by_entity(asset: Asset, check: Compiled) -> Column:
    """check, part, checked, failed, own score and samples of one entity, for each part."""
    def one(label: str, checked: Column, failed: Column, score: Column, samples: Column) -> Column:
        return F.struct(F.lit(check.key).alias("check"), F.lit(label).alias("part"), checked.cast("bigint").alias("checked"), failed.cast("bigint").alias("failed"), score.cast("double").alias("own"), samples.cast(f"array<{SAMPLE}>").alias("samples"))

    if check.by_entity:
        return F.array(one("", *check.by_entity))
    null, rows = F.lit(None).cast("double"), []
    for p in check.parts:
        shown = F.when(p.bad, F.struct(_time(Context(asset, {}, {}, {})), p.value.alias("value")))
        rows.append(one(p.label, F.count(p.bad), F.count_if(p.bad), null, least_rows(shown, check.samples)))
    return F.array(*rows)


def outcome(df: DataFrame, asset: Asset, checks: list[Compiled]) -> DataFrame:
    """The results (RESULT) of compiled checks. df has the asset's columns and ``local_now``, the clock of the row's
    entity or null. One scan serves all checks of rows, and one each set of keys."""
    entity = F.coalesce(F.col(asset.entity).cast("string"), F.lit("null")).alias("_entity")
    found = None
    for keys in dict.fromkeys(c.keys for c in checks):
        own = [c for c in checks if c.keys == keys]
        d = df.withColumn("_entity", entity)
        if keys:
            # The clock belongs to the entity, so it splits no key.
            d = d.groupBy("_entity", "local_now", *keys).agg(F.count("*").alias("_n"))
        rows = d.groupBy("_entity").agg(*(_by_entity(asset, c).alias(f"_c{i}") for i, c in enumerate(own)))
        rows = rows.select("_entity", F.inline(F.flatten(F.array(*(F.col(f"_c{i}") for i in range(len(own)))))))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return df.sparkSession.createDataFrame([], RESULT)
    # A row of zeros, so that a check that meets no row has a result.
    blank = [(None, c.key, c.parts[0].label if c.parts else "", 0, 0, None, []) for c in checks]
    found = found.unionByName(df.sparkSession.createDataFrame(blank, f"_entity string, check string, part string, checked bigint, failed bigint, own double, samples array<{SAMPLE}>"))
    # Each entity's samples are few; over all entities the bounded aggregate keeps the least ones again.
    d = found.select("*", F.posexplode_outer("samples").alias("_k", "_s")).withColumn("_first", F.coalesce(F.col("_k"), F.lit(0)) == 0)
    shown = F.when(F.col("_s").isNotNull(), F.struct(F.col("part"), F.col("_entity").alias("entity"), F.col("_s.time").alias("time"), F.col("_s.value").alias("value")))
    only = lambda c: F.when(F.col("_first"), F.col(c))
    of = lambda f, default: reduce(lambda out, c: out.when(F.col("check") == c.key, f(c)), checks, F.when(F.lit(False), default))
    most = max((c.samples for c in checks), default=5)
    parts = d.groupBy("check", "part").agg(F.sum(only("checked")).alias("checked"), F.sum(only("failed")).alias("failed"), F.sum(only("own")).alias("own"), F.count(only("own")).alias("owners"), least_rows(shown, most).alias("samples"))
    line = lambda c: S.linear_score(1 - F.try_divide("failed", "checked"), 1 - c.rates[0], 1 - c.rates[1])
    parts = parts.withColumns({"score": of(lambda c: line(c) if c.each else F.lit(None).cast("double"), F.lit(0.0)), "samples": F.slice("samples", 1, of(lambda c: F.lit(c.samples), F.lit(0)))})
    total = parts.groupBy("check").agg(F.sum("checked").alias("checked"), F.sum("failed").alias("failed"), F.sum("own").alias("own"), F.sum("owners").alias("owners"), F.avg("score").alias("mean"), F.flatten(F.array_sort(F.collect_list("samples"))).alias("samples"))  # a check's parts

    def score(c: Compiled) -> Column:
        if c.each:
            return F.col("mean")
        if c.mean:
            return S.linear_score(F.least(F.lit(1.0), F.try_divide("own", "checked") / c.rates[0]), 1.0, c.rates[1] / c.rates[0])
        return F.when(F.col("owners") > 0, F.try_divide("own", "owners")).otherwise(line(c))

    # A little up, so that a mean that should lie on a half isn't moved by the order of its sum.
    d = total.withColumn("score", F.round(F.when(F.col("checked") > 0, of(score, F.lit(0.0))) + 1e-9, 2))
    status = F.when(F.col("score").isNull(), "skipped").when(F.col("score") >= quality.PASS, "passed").when(F.col("score") >= quality.WARN, "warning").otherwise("failed")
    message = F.when(F.col("score").isNull(), "nothing to judge").otherwise(F.concat_ws(" ", F.col("failed").cast("string"), F.lit("of"), F.col("checked").cast("string"), F.lit("fail")))
    return d.select("check", of(lambda c: F.lit(c.dimension), F.lit("")).alias("dimension"), of(lambda c: F.lit(c.severity), F.lit("")).alias("severity"), status.alias("status"), "score", F.coalesce("checked", F.lit(0)).cast("bigint").alias("checked"), F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"), "samples", message.alias("message"))


def clocked(df: DataFrame, asset: Asset, clocks: DataFrame | None) -> DataFrame:
    """df with ``local_now`` of its entity; null without clocks (entity, local_now)."""
    if clocks is None:
        return df.withColumn("local_now", F.lit(None).cast("timestamp_ntz"))
    c = clocks.select(F.col("entity").alias("_clock"), F.col("local_now").cast("timestamp_ntz").alias("local_now"))
    return df.drop("local_now").join(c, F.col(asset.entity).cast("string") == F.col("_clock").cast("string"), "left").drop("_clock")


def _planned(checks: list[Compiled]) -> list[Compiled]:
    return [c for c in checks if not (c.skipped or c.error or c.known)]


def _note(c: Compiled) -> tuple:
    """The result of a check that has no plan."""
    if c.known and not c.error:
        checked, failed, values = c.known
        score = round(100.0 * (checked - failed) / checked, 2)
        status = "passed" if score >= quality.PASS else "warning" if score >= quality.WARN else "failed"
        return (c.key, c.dimension, c.severity, status, score, checked, failed, [("", None, None, v) for v in values], f"{failed} of {checked} fail")
    return (c.key, c.dimension, c.severity, "error" if c.error else "skipped", None, 0, 0, [], c.error or c.skipped or "nothing to judge")


def lazy(df: DataFrame, asset: Asset, rules: str | Mapping[str, Any], clocks: DataFrame | None = None) -> DataFrame:
    """Results of all checks as one plan, for rules that are known to be right; those that can't be compiled have
    their rows as well, and so has a planned one that finds no row at all."""
    checks = compile_checks(asset, load(rules), dict(df.dtypes))
    planned = _planned(checks)
    rest = [_note(c) for c in checks if c.skipped or c.error or c.known]
    got = outcome(clocked(df, asset, clocks), asset, planned)
    return got.unionByName(df.sparkSession.createDataFrame(rest, RESULT)) if rest else got


def run(df: DataFrame, asset: Asset, rules: str | Mapping[str, Any], clocks: DataFrame | None = None) -> DataFrame:
    """Results of all checks, each alone: expressions are analysed one check at a time first; if the common aggregate
    then fails when it runs, its checks are halved until those that fail stand alone. A row for each check comes to
    the driver."""
    checks = compile_checks(asset, load(rules), dict(df.dtypes))
    d, good, rows = clocked(df, asset, clocks), [], {c.key: _note(c) for c in checks}
    for c in _planned(checks):
        try:
            outcome(d, asset, [c]).schema  # noqa: B018  analyses it
            good.append(c)
        except PySparkException as e:
            rows[c.key] = _note(replace(c, error=_first_line(e)))

    def attempt(some: list[Compiled]) -> None:
        try:
            rows.update({r["check"]: tuple(r) for r in outcome(d, asset, some).collect()})
        except PySparkException as e:
            if len(some) == 1:
                rows[some[0].key] = _note(replace(some[0], error=_first_line(e)))
            else:
                attempt(some[: len(some) // 2])
                attempt(some[len(some) // 2 :])

    if good:
        attempt(good)
    return df.sparkSession.createDataFrame(list(rows.values()), RESULT)


def _first_line(e: Exception) -> str:
    return str(e).strip().splitlines()[0][:300]


def shown(samples: Column) -> Column:
    """Samples as one text: part, entity, time and value of each."""
    return F.array_join(F.transform(samples, lambda s: F.concat_ws("|", s["part"], s["entity"], F.coalesce(s["time"], F.lit("")), s["value"])), "; ")
