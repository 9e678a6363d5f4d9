"""Parameter parsing on columns: positive integers and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import col_of, strip_text

# Fixed value: items of one digest, at most.
DIGEST_MAX = 20


def parse_int(value: Column | str) -> Column:
    """Whole number written in decimal digits, else null."""
    text = strip_text(col_of(value).cast("string"))
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))


def positive_int(value: Column | str, default: int) -> Column:
    parsed = parse_int(value)
    return F.when(parsed > 0, parsed).otherwise(F.lit(default))


def clamp_int(value: Column | str, default: int, low: int, high: int) -> Column:
    parsed = F.coalesce(parse_int(value), F.lit(default))
    return F.least(F.greatest(parsed, F.lit(low)), F.lit(high))


def clamp(value: int | str | None, default: int, low: int, high: int) -> int:
    """Driver-side clamp of a job parameter."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        number = default
    return min(max(number, low), high)


def digest_limit(value: int | str | None) -> int:
    return clamp(value, default=10, low=1, high=DIGEST_MAX)
