from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pytest

from pyspark.sql import functions as F

from feedloom.functions.dates import parse_datetime
from feedloom.functions.slots import local_time
from feedloom.operators.messages import delivery_events


def stdlib_time(value):
    if not value:
        return None
    try:
        parsed = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        try:
            parsed = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
    if parsed.tzinfo is None:
        parsed = parsed.replace(tzinfo=timezone.utc)
    return parsed.astimezone(timezone.utc).replace(tzinfo=None)


CASES = [
    "Wed, 10 Jun 2026 12:00:00 GMT", "Wed, 10 Jun 2026 12:00:00 +0800", "10 Jun 2026 12:00 EST",
    "Wed, 10 Jun 26 12:00:00 -0330", "10 Jun 99 01:02:03 PDT", "Wed, 10 Jun 2026 12:00:00 -0000",
    "Wed, 10 June 2026 12:00:00 Z", "10-Jun-2026 12:00:00 GMT", "Wed,10 Jun 2026 12:00:00 UT",
    "2026-06-10T12:00:00Z", "2026-06-10T12:00:00+08:00", "2026-06-10 12:00:00.123456", "2026-06-10",
    "2026-06-10T12:00:00.5-05:30", "20260610T120000Z", "2026-06-10T12:00", "2026-06-10T12",
    "", None, "bad", "2026-13-01T00:00:00Z", "32 Jun 2026 00:00:00 GMT", "2026-06-10T25:00:00Z",
    "10 Foo 2026 12:00:00 GMT", "1 Jan 2024 00:00:00 +0000 (UTC)", "Wednesday, 10 Jun 2026 12:00:00 MST",
    "2026-06-10T12:00:00.1234567Z", "10 Jun 2026 12:00:00",
    "Wed, 10 Jun 2026 12:00:00 +08:00", "Jun 10, 2026 12:00:00 GMT", "Wed Jun 10 12:00:00 2026",
    "Wed, 10 Jun 2026 12.30.00 GMT", "10 Jun 2026 12:00:00 GMT+2", "Wednesday, June 10, 2026 12:00:00 -0700",
    "10 Sept 2026 12:00:00 GMT", "2026-06-10T12:00:00z", "10 September 2026 12:00:00 GMT", "Jun 10 2026 12:00:00 EDT",
    "Wed Jun 10 12:00:00 +0800 2026", "Wed Jun 10 12:00:00 GMT 2026", "Wed, 10 Jun 2026", "10 Jun 2026 12.30 GMT",
    "Wed, 10 Jun 2026 12:00 PM", "10 Jun, 2026 12:00:00 GMT", "10 Jun 2026 12:00:00 -5", "Wednesday 10 Jun 2026 12:00:00 GMT",
    "Wed, Jun 10 2026 12:00:00 UTC", "10 Jun 2026 12:00:00 +0800 (CST)",
    "2026-W24-3", "2026W243", "2026-W24", "2026W24", "2026-W24-3T12:00:00Z", "2026-W24-3 12:00:00.5+08:00", "2026W243T120000Z",
    "2026-W01-1", "2026-W53-7", "2025-W53-1", "2026-W00-1", "2026-W54-1", "2026-W24-0", "2026-W24-8", "2026-W243", "2026W24-3",
    "2026-W24-3T25:00", "2024-W01-1", "2021-W53", "2020-W53-5", "0000-W01-1", "2026-W24T09:00",
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, v string")
    out = rows.select("i", parse_datetime("v").cast("timestamp_ntz").alias("o")).orderBy("i")
    return dict(zip(CASES, [r.o for r in out.collect()]))


@pytest.mark.parametrize("value", CASES)
def test_publish_times_agree_with_the_standard_library(parsed, value):
    assert parsed[value] == stdlib_time(value)


def test_wall_clock_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.sql("SELECT timestamp_micros(1781366400123456) AS t, timestamp_ntz'2026-06-13 16:00:00.123456' AS n")
        got = row.select(local_time(F.col("t")).alias("a"), local_time(F.col("n")).alias("b")).first()
        events = delivery_events(spark.range(1), "r", datetime(2026, 6, 13, 16, tzinfo=timezone.utc)).first()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        again = delivery_events(spark.range(1), "r", datetime(2026, 6, 13, 16, tzinfo=timezone.utc)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.a == got.b == datetime(2026, 6, 14, 0, 0, 0, 123456)
    assert events.id == again.id
