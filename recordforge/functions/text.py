"""Text, time and number formats that reports and ids use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """Blanks become `_` and slashes become `-`."""
    return F.translate(name.cast("string"), " /", "_-")


def truthy(value: Column, dtype) -> Column:
    """Python truth of a value, by its Spark type; NULL stays NULL."""
    kind = dtype.typeName()
    if kind == "boolean":
        return value
    if kind in ("string", "varchar", "char"):
        return F.length(value) > 0
    if kind in ("array", "map"):
        return F.size(value) > 0
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return value != 0
    return F.when(value.isNotNull(), F.lit(True))


def python_text(value: Column, dtype) -> Column:
    """A value as it reads in a message: booleans capitalized, the rest cast to text."""
    text = value.cast("string") if dtype.typeName() not in ("array", "map", "struct", "variant") else F.to_json(value)
    return F.initcap(text) if dtype.typeName() == "boolean" else text


def duration_seconds(text: Column) -> Column:
    """`90`, `30s`, `5m`, `2h` or `1h30m45s` as seconds; a plain number is seconds, malformed text is NULL."""
    clean = F.lower(F.trim(text))

    def part(unit: str) -> Column:
        found = F.regexp_extract(clean, rf"([0-9]+){unit}", 1)
        return F.coalesce(F.when(found != "", found.cast("bigint")), F.lit(0))

    plain = F.when(clean.rlike("^[+-]?[0-9]+$"), clean.cast("bigint"))
    parts = F.when(
        clean.rlike("^([0-9]+h)?([0-9]+m)?([0-9]+s)?$") & (clean != ""),
        part("h") * 3600 + part("m") * 60 + part("s"),
    )
    return F.coalesce(plain, parts)


def elapsed_text(seconds: Column) -> Column:
    """`45s`, `3m 5s` or `2h 15m 30s`."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%dh %dm %ds", h, m, r))
    )


def clock_text(seconds: Column) -> Column:
    """`MM:SS`, or `H:MM:SS` from one hour on; `--` if unknown."""
    s = F.greatest(seconds, F.lit(0)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(seconds.isNull(), F.lit("--"))
        .when(h > 0, F.format_string("%d:%02d:%02d", h, m, r))
        .otherwise(F.format_string("%02d:%02d", m, r))
    )


def span_text(start: Column, end: Column) -> Column:
    """Time between two timestamps; `in progress` without an end, `unknown` without a start or if negative."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return (
        F.when(start.isNull(), F.lit("unknown"))
        .when(end.isNull(), F.lit("in progress"))
        .when(seconds < 0, F.lit("unknown"))
        .otherwise(elapsed_text(seconds))
    )


def eta_seconds(elapsed: Column, progress: Column) -> Column:
    """Linear estimate of the time left; NULL where none can be made."""
    usable = (elapsed > 0) & (progress > 0) & (progress < 100)
    return F.when(usable, F.try_divide(elapsed * (F.lit(100) - progress), progress))


def eta_text(seconds: Column) -> Column:
    """`~<1m`, `~12m`, `~1h 30m`, or a dash when unknown."""
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(seconds.isNull() | (seconds <= 0), F.lit("\u2014"))
        .when(s < 60, F.lit("~<1m"))
        .when(s < 3600, F.format_string("~%dm", m))
        .when(m > 0, F.format_string("~%dh %dm", h, m))
        .otherwise(F.format_string("~%dh", h))
    )


def token_text(tokens: Column) -> Column:
    """`950`, `4.5K` or `1.2M`."""
    t = tokens.cast("double")
    return (
        F.when(t >= 1e6, F.concat(F.replace(F.format_number(t / 1e6, 1), F.lit(",")), F.lit("M")))
        .when(t >= 1e3, F.concat(F.format_number(t / 1e3, 1), F.lit("K")))
        .otherwise(tokens.cast("bigint").cast("string"))
    )


def repetition_base(unit_id: Column) -> Column:
    """The unit id before its last `__rep` mark."""
    return F.when(unit_id.contains("__rep"), F.regexp_extract(unit_id, r"(?s)^(.*)__rep", 1)).otherwise(unit_id)


def shorten(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
