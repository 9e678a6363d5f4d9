"""Retry policy of rejected records: exponential backoff, then dead."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attempts, first delay and longest delay in seconds.
MAX_ATTEMPTS = 3
BASE_SECONDS = 5
MAX_SECONDS = 300
LEASE_SECONDS = 600


def backoff_seconds(attempts: Column) -> Column:
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(10))
    return F.least(F.lit(MAX_SECONDS), F.lit(BASE_SECONDS) * F.pow(F.lit(2), exponent).cast("int"))


def retry_state(
    failures: DataFrame, key: str, at: str, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """(key, attempts, last_failed_at, status, next_retry_at) from a failure log."""
    grouped = failures.groupBy(key).agg(
        F.count("*").alias("attempts"), F.max(at).alias("last_failed_at")
    )
    dead = F.col("attempts") >= max_attempts
    delay = F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return grouped.withColumns(
        {
            "status": F.when(dead, F.lit("dead")).otherwise(F.lit("pending")),
            "next_retry_at": F.when(~dead, F.col("last_failed_at") + delay),
        }
    )


def grantable(
    asked: DataFrame, leases: DataFrame, done: DataFrame, writer: str, batch_id: int, now: datetime
) -> DataFrame:
    """Rows of ``asked`` (item_id) on which no other batch holds a lease at ``now``.

    ``leases`` has item_id, leased_until, writer and batch_id, ``done`` the writer and batch_id of
    ended batches, which hold none. Every batch logs its leases before it reads those of others, so of
    two at least one sees the other and steps back; where both do, the item stays due for their next.
    """
    other = ~((F.col("writer") == writer) & (F.col("batch_id") == batch_id))
    live = leases.filter(other & (F.col("leased_until") > F.lit(now).cast("timestamp")))
    ended = done.select("writer", "batch_id").distinct()
    held = live.join(ended, ["writer", "batch_id"], "left_anti").select("item_id").distinct()
    return asked.join(held, "item_id", "left_anti")
