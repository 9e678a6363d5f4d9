"""Digest slots: schedule strings (driver-side parameters) and next-slot columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default digest times and zone.
DEFAULT_TIMES = "09:00,17:00"
DEFAULT_HOURS = "9,17"
DEFAULT_ZONE = "Asia/Shanghai"


def schedule_hours(value: str) -> list[int]:
    """Hours of the day as minutes, sorted and distinct; 9 and 17 when none is valid."""
    numbers = [p.strip() for p in value.split(",")]
    hours = {int(p) for p in numbers if re.fullmatch(r"[+-]?\d+", p)}
    valid = sorted(60 * h for h in hours if 0 <= h <= 23)
    return valid or [9 * 60, 17 * 60]


def schedule_times(value: str = DEFAULT_TIMES, fallback_hours: str = DEFAULT_HOURS) -> list[int]:
    """``HH:MM`` list as minutes of the day; falls back to the hour list."""
    minutes = set()
    for part in value.split(","):
        match = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", part)
        if match and int(match[1]) <= 23 and int(match[2]) <= 59:
            minutes.add(60 * int(match[1]) + int(match[2]))
    return sorted(minutes) or schedule_hours(fallback_hours)


def slot_after(instant: datetime, minutes: list[int], zone: str = DEFAULT_ZONE) -> datetime:
    """The instant of the first slot of the local day strictly after ``instant``."""
    local = instant.astimezone(ZoneInfo(zone))
    midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
    for day in (0, 1, 2):
        for minute in minutes:
            at = (midnight + timedelta(days=day)).replace(hour=minute // 60, minute=minute % 60)
            if at.astimezone(ZoneInfo("UTC")) > instant:
                return at.astimezone(instant.tzinfo)
    raise ValueError("no slots")


def local_time(instant: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Wall-clock time (no zone) of an instant, or of a UTC wall-clock column; any session zone."""
    micros = F.unix_micros(instant.cast("timestamp")).cast("decimal(20,0)") / 1_000_000
    since = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=micros.cast("decimal(18,6)"))
    utc = F.when(F.typeof(instant) == "timestamp", since).otherwise(instant.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def next_slot(local: Column, minutes: list[int]) -> Column:
    """The first slot strictly after ``local``: later today, else tomorrow's first."""
    day = F.date_trunc("DAY", local).cast("timestamp_ntz")
    slot = day + F.make_dt_interval(days=F.lit(1), mins=F.lit(minutes[0]))
    for minute in reversed(minutes):
        at = day + F.make_dt_interval(mins=F.lit(minute))
        slot = F.when(at > local, at).otherwise(slot)
    return slot
