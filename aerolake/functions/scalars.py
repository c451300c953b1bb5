"""Scalar functions as column expressions: texts, identifiers, times, hashes, arrays, maps and JSON."""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain ones that they become in a slug.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def slug(c: Column) -> Column:
    """Small ASCII letters and digits with single hyphens between; marks of Latin letters go."""
    plain = F.translate(F.lower(c), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slugify(text: str) -> str:
    """The same for a text on the driver, with every mark that Unicode can take off."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return "-".join("".join(c if c.isalnum() else " " for c in plain).split())


def short_label(description: Column, name: Column) -> Column:
    """What stands before the first bracket of a description; the name if that is empty."""
    head = F.trim(F.element_at(F.split(description, r"[（(]"), 1))
    return F.when(F.length(head) > 0, head).otherwise(name)


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def contains_text(c: Column, needle: str) -> Column:
    """Whether it holds the needle, whatever the case; null: no."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.strip().lower())), F.lit(False))


def url_part(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def floor_hour(t: Column) -> Column:
    return F.date_trunc("hour", t).cast("timestamp_ntz")


def floor_day(t: Column) -> Column:
    return F.date_trunc("day", t).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours, 0 at least."""
    return F.greatest(F.lit(0), F.timestamp_diff("HOUR", start, end))


def days_of(first: Column, last: Column) -> Column:
    """Array of all days of an inclusive range; empty if it ends before it begins."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def months_of(first: Column, last: Column) -> Column:
    """Array of the months (yyyy-MM) that an inclusive range of times touches."""
    a, b = F.date_trunc("month", first).cast("date"), F.date_trunc("month", last).cast("date")
    return F.when(a <= b, F.transform(F.sequence(a, b, F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyy-MM"))).otherwise(F.array().cast("array<string>"))


def parse_time(c: Column) -> Column:
    """ISO text, also of a day alone, with a blank for T or with Z, as a time without zone; else null."""
    return F.replace(F.regexp_replace(c, "Z$", ""), F.lit(" "), F.lit("T")).try_cast("timestamp_ntz")


def iso_z(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative_time(t: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit."""
    s = F.timestamp_diff("SECOND", t, now)
    unit = lambda size, name: F.concat(F.floor(s / size).cast("string"), F.lit(f" {name} ago"))
    return F.when(s.isNull(), None).when(s < 60, "just now").when(s < 3600, unit(60, "min")).when(s < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def canonical(value) -> str:
    """JSON with sorted keys and no blanks, so that equal values have equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def sha_of(value) -> str:
    return sha256(canonical(value).encode()).hexdigest()


def row_hash(*columns: str, length: int = 64) -> Column:
    """The first digits of the SHA-256 of the columns as JSON, with nulls kept."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, length)


def run_id(prefix: str, at: Column, salt: Column) -> Column:
    """prefix, time and six digits of a hash of the salt; the same for the same inputs."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(at, "yyyyMMdd'T'HHmmss"), F.substring(F.sha2(salt.cast("string"), 256), 1, 6))


def chunks(c: Column, size: int) -> Column:
    """An array cut into arrays of ``size``, the last one shorter."""
    return F.transform(F.when(F.size(c) > 0, F.sequence(F.lit(0), F.floor((F.size(c) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(c, i * size + 1, size))


def unique(c: Column) -> Column:
    """An array without repeats, in the order of the first ones."""
    return F.array_distinct(c)


def first_k(c: Column, k: int) -> Column:
    return F.slice(c, 1, k)


def merged(base: Column, over: Column) -> Column:
    """Two maps as one; the second one wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def deep_merge(base: dict, over: dict) -> dict:
    """Nested dictionaries as one, on the driver; the second one wins."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def zero_filled(counts: Column, keys: list[str]) -> Column:
    """A map with all these keys, in order; those it lacks count 0."""
    return F.map_from_arrays(F.lit(keys), F.transform(F.lit(keys), lambda k: F.coalesce(F.try_element_at(counts, k), F.lit(0))))


def cell(c: Column, kind: str) -> Column:
    """A value as the text of a table cell: nested ones as JSON, null as an empty text."""
    return F.coalesce(F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string"), F.lit(""))
