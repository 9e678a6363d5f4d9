"""Outbound messages and the append-only delivery log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.cards import with_push_card
from feedloom.operators.routing import not_yet_sent
from feedloom.schemas import CHANNEL

# Message ids where nothing is handed over.
DRY_RUN = "dry-run"
DIGEST_DRY_RUN = "dry-run:digest"


def push_candidates(
    items: DataFrame, push_events: DataFrame, force: bool = False, recipient_scope: str | None = None
) -> DataFrame:
    """Items routed to an immediate push, unless a successful push exists."""
    return not_yet_sent(items, push_events, recipient_scope, force)


def push_messages(items: DataFrame) -> DataFrame:
    """One outbound card per item; handing it over is left to the caller."""
    return with_push_card(items)


def delivery_events(
    messages: DataFrame,
    recipient: str,
    now: datetime,
    message_id: Column | str = DRY_RUN,
    error: Column | None = None,
) -> DataFrame:
    """Log rows for messages with an id; a null error means sent, failures keep their text."""
    text = F.lit(None).cast("string") if error is None else error
    message = F.lit(message_id) if isinstance(message_id, str) else message_id
    at = F.lit(now).cast("timestamp")
    key = F.concat_ws("\n", F.col("id").cast("string"), F.lit(recipient), F.unix_micros(at).cast("string"))
    return messages.select(
        F.sha2(key, 256).alias("id"),
        F.col("id").cast("string").alias("item_id"),
        F.lit(CHANNEL).alias("channel"),
        F.lit(recipient).alias("recipient"),
        message.alias("message_id"),
        F.when(text.isNull(), F.lit("sent")).otherwise(F.lit("failed")).alias("status"),
        at.alias("sent_at"),
        text.alias("last_error"),
        at.alias("created_at"),
    )
