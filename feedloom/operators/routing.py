"""Routing by score, delivery checks and the derived item status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import distinct_keys

# Default routing thresholds.
PUSH_MIN = 0.75
DIGEST_MIN = -1.0


def route(score: Column, push_min: float = PUSH_MIN, digest_min: float = DIGEST_MIN) -> Column:
    """push, digest or archive by the stored (rounded) score."""
    value = score.cast("double")
    return (
        F.when(value >= push_min, F.lit("push"))
        .when(value >= digest_min, F.lit("digest"))
        .otherwise(F.lit("archive"))
    )


def score_band(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    value = F.col(score).cast("double")
    return df.filter((value >= low) & (value < high))


def sent_items(push_events: DataFrame, recipient: str | None = None) -> DataFrame:
    """Distinct ids of items with a successful push, optionally to one recipient."""
    sent = push_events.filter(F.col("status") == "sent")
    if recipient is not None:
        sent = sent.filter(F.col("recipient") == recipient)
    return distinct_keys(sent, "item_id")


def not_yet_sent(
    items: DataFrame,
    push_events: DataFrame,
    recipient: str | None = None,
    force: bool = False,
    item_id: str = "id",
) -> DataFrame:
    """Items without a successful push; all of them when forced."""
    if force:
        return items
    sent = sent_items(push_events, recipient)
    return items.join(sent, F.col(item_id) == F.col("item_id"), "left_anti")


def past_stage_skip(items: DataFrame, status: str = "status", past: list[str] | None = None) -> DataFrame:
    """Items that analysis may still touch."""
    return items.filter(~F.col(status).isin(past or ["pushed", "archived", "ignored"]))


def with_status(
    items: DataFrame,
    latest_analysis: DataFrame,
    push_events: DataFrame,
    single_recipient: str,
    push_min: float = PUSH_MIN,
    digest_min: float = DIGEST_MIN,
) -> DataFrame:
    """Status from the logs instead of mutable state.

    ``items`` has id and is_duplicate, ``latest_analysis`` one row per item_id. Digest deliveries
    leave the status alone, so only pushes to ``single_recipient`` count.
    """
    pushed = sent_items(push_events, single_recipient).withColumn("__pushed", F.lit(True))
    scores = latest_analysis.select("item_id", F.col("importance_score").alias("__score"))
    logs = scores.join(pushed, "item_id", "full").withColumnRenamed("item_id", "__item")
    joined = items.join(logs, F.col("id") == F.col("__item"), "left")
    status = (
        F.when(F.col("is_duplicate"), F.lit("ignored"))
        .when(F.col("__pushed"), F.lit("pushed"))
        .when(F.col("__score").isNull(), F.lit("new"))
        .when(route(F.col("__score"), push_min, digest_min) == "archive", F.lit("archived"))
        .otherwise(F.lit("ready"))
    )
    return joined.select(*items.columns, status.alias("status"))
