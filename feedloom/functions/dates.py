"""Publish-time parsing on columns: RFC 822 first, then ISO 8601; naive times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.payload import is_filled
from feedloom.functions.text import bind, col_of

# Named zones of RFC 822 as minutes east of UTC.
ZONE_MINUTES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_DAY = r"(?:[a-z]+,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|"
    r"oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_TIME = r"\d{1,2}[:.]\d{2}(?:[:.]\d{2})?"
# Other orders of the parts, and how they become day, month, year, time, zone.
_MONTH_FIRST = rf"(?i)\A{_DAY}{_MONTH}[\s-]+(\d{{1,2}}),?[\s-]+(\d{{4}}|\d{{2}})(,?\s.*)\z", "$2 $1 $3$4"
_YEAR_LAST = rf"(?i)\A{_DAY}{_MONTH}\s+(\d{{1,2}})\s+({_TIME})\s+(?:([a-z+-]\S*)\s+)?(\d{{4}})\z", "$2 $1 $5 $3 $4"
_RFC822 = (
    rf"(?i)\A{_DAY}(\d{{1,2}})[\s-]+{_MONTH}[\s-]+(\d{{4}}|\d{{2}}),?\s+"
    r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?(?:\s+(\S+)(?:\s.*)?)?\s*\z"
)
_ISO8601 = (
    r"\A(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,}))?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?\z"
)
# An ISO week date, with dashes or without, and what follows it.
_WEEK_DATE = r"(?s)\A(\d{4})(?:-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)((?:[^\d-].*)?)\z"
_SEP = "\u0001"


def _matched(text: Column, pattern: str, count: int, body) -> Column:
    """``body(groups)`` for the capture groups of a full match, else null."""
    groups = F.split(
        F.regexp_replace(text, pattern, _SEP.join(f"${i}" for i in range(1, count + 1))), _SEP, count
    )

    def on_match(parts: Column) -> Column:
        return F.when(
            F.size(parts) == count, body(*[F.get(parts, F.lit(i)) for i in range(count)])
        )

    return bind(groups, on_match)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _instant(year, month, day, hour, minute, second, offset_seconds) -> Column:
    local = F.try_make_timestamp(year, month, day, hour, minute, second, F.lit("UTC"))
    return local - F.make_dt_interval(secs=offset_seconds.cast("decimal(18,6)"))


def _offset(zone: Column) -> Column:
    """Seconds east of UTC of ``+hhmm``, ``+hh:mm`` or ``+hh:mm:ss``; null for a named zone."""
    digits = F.replace(F.substring(zone, 2, 8), F.lit(":"), F.lit(""))
    seconds = (
        _number(F.substring(digits, 1, 2)) * 3600
        + _number(F.substring(digits, 3, 2)) * 60
        + _number(F.substring(digits, 5, 2))
    )
    return F.when(zone.startswith("-"), -seconds).when(zone.startswith("+"), seconds)


def _hhmm_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a signed number hhmm; null for anything else."""
    number = F.when(zone.rlike(r"^[+-]\d{1,6}$"), zone).try_cast("int")
    size = F.abs(number)
    return F.signum(number).cast("int") * (F.floor(size / 100) * 3600 + size % 100 * 60).cast("int")


def _rfc822_time(day, month, year, hour, minute, second, zone) -> Column:
    short_month = F.lower(F.substring(month, 1, 3))
    month_number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), short_month)
    short = F.when(_number(year) > 68, _number(year) + 1900).otherwise(_number(year) + 2000)
    full_year = F.when(F.length(year) == 2, short).otherwise(_number(year))
    named = F.coalesce(*[F.when(F.upper(zone) == z, F.lit(m * 60)) for z, m in ZONE_MINUTES.items()])
    return _instant(
        full_year,
        month_number.cast("int"),
        _number(day),
        _number(hour),
        _number(minute),
        _number(second),
        F.coalesce(_hhmm_seconds(zone), named, F.lit(0)),
    )


def _iso_time(year, month, day, hour, minute, second, fraction, zone) -> Column:
    micros = F.substring(F.rpad(fraction, 6, "0"), 1, 6)
    seconds = F.concat(_number(second).cast("string"), F.lit("."), micros).cast("decimal(8,6)")
    offset = F.coalesce(_offset(zone), F.lit(0))
    return _instant(
        _number(year), _number(month), _number(day), _number(hour), _number(minute), seconds, offset
    )


def _calendar_date(text: Column) -> Column:
    """An ISO week date at the start as year, month and day; null for a week or day that does not exist."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _WEEK_DATE, i)

    year, week, day = _number(part(1)), _number(F.concat(part(2), part(4))), F.concat(part(3), part(5))
    day = F.when(day == "", 1).otherwise(_number(day))
    # always in week 1
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    date = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    real = (F.weekofyear(date) == week) & day.between(1, 7) & (year > 0)
    return F.when(real, F.concat(F.date_format(date, "yyyy-MM-dd"), part(6)))


def _day_first(text: Column) -> Column:
    """A date with its month first or its year last, in the usual order; others unchanged."""
    return F.regexp_replace(F.regexp_replace(text, *_MONTH_FIRST), *_YEAR_LAST)


def parse_datetime(value: Column | str) -> Column:
    """Timestamp of a feed date; null when it cannot be read. An unknown zone counts as UTC."""
    return bind(
        F.trim(col_of(value)),
        lambda text: F.coalesce(
            _matched(_day_first(text), _RFC822, 7, _rfc822_time), _matched(text, _ISO8601, 8, _iso_time),
            _matched(F.when(text.rlike(_WEEK_DATE), _calendar_date(text)), _ISO8601, 8, _iso_time),
        ),
    )


def epoch_datetime(*values: Column) -> Column:
    """The first filled JSON value (VARIANT) as epoch seconds; null where that is not a number.

    Missing, null, zero, false and empty values go on to the next one; a text never does.
    """

    def scalar(value: Column) -> Column:
        return F.struct(
            F.try_variant_get(value, "$", "string").alias("value"), F.schema_of_variant(value).alias("type")
        )

    chosen = F.coalesce(*[F.when(is_filled(scalar(v)), scalar(v)) for v in values])

    def instant(found: Column) -> Column:
        number = F.when(found["type"] == "BOOLEAN", F.lit(1.0)).when(
            found["type"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), found["value"].try_cast("double")
        )
        return F.timestamp_seconds(number)

    return bind(chosen, instant)
