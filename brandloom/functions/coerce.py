"""Coercions that the operators share: lists that may be JSON text, numbers that may be text, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: Column | str, places: int = 0) -> Column:
    """Halves go up, on the binary value, as floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**places)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """x within low and high; NaN and null are low. x stands here once, as lambdas work out all that is written."""
    low = F.lit(float(low))
    return F.greatest(low, F.least(F.lit(float(high)), F.coalesce(F.nanvl(col(x).cast("double"), low), low)))


def finite(x: Column | str) -> Column:
    """A finite double from a number or text, else null."""
    d = col(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def string_list(x: Column | str, lone: str = "drop") -> Column:
    """An array of non-empty strings from JSON text. Text that isn't a JSON array: drop it, wrap it, or split it at commas (lone)."""
    x = col(x)
    parsed = F.from_json(x, "array<string>")
    other = {"drop": F.array().cast("array<string>"), "wrap": F.array(x), "csv": F.transform(F.split(x, ","), lambda s: F.trim(s))}[lone]
    is_json = F.coalesce(F.trim(x).startswith("["), F.lit(False)) & parsed.isNotNull()
    return F.coalesce(F.filter(F.when(is_json, parsed).otherwise(other), lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))


def json_object(x: Column | str) -> Column:
    """JSON text if it is an object, else an empty object."""
    x = F.trim(col(x))
    return F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x).otherwise(F.lit("{}"))


def distinct_texts(xs: Column | str, fold: bool = True) -> Column:
    """Trimmed, non-empty, first-seen order; fold: lower-cased, otherwise the first casing stays."""
    clean = F.filter(F.transform(col(xs), lambda s: F.regexp_replace(F.coalesce(s, F.lit("")), r"^[\s ]+|[\s ]+$", "")), lambda s: s != "")
    if fold:
        return F.array_distinct(F.transform(clean, F.lower))
    lowered = F.transform(clean, F.lower)
    return F.filter(clean, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)


def clamp_int(value, low: int, high: int, default: int) -> int:
    """A request's number as an int within bounds."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return default
    return max(low, min(high, int(value + 0.5)))
