"""Feedback intake: field lookup in nested payloads, validation, log rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.payload import first_scalar, is_filled
from feedloom.operators.stage import compute_once
from feedloom.schemas import FEEDBACK_ACTIONS, NOTE_ACTION

# Accepted spellings of each field, in lookup order.
FIELD_KEYS = {
    "item_id": ["item_id", "itemId"],
    "action": ["action", "value"],
    "push_event_id": ["push_event_id", "pushEventId"],
    "user_id": ["user_id", "userId", "open_id", "openId"],
}
# What a refused callback is told.
MISSING = "item_id and action are required"
UNKNOWN_ACTION = "invalid feedback action"
MALFORMED = "payload is not a JSON object"


def feedback_fields(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Add item_id, action, push_event_id, user_id and ``problem`` (null when valid)."""
    parsed = compute_once(events, {"__json": F.try_parse_json(payload)})
    found = compute_once(
        parsed,
        {f"__{name}": first_scalar(F.col("__json"), *keys) for name, keys in FIELD_KEYS.items()},
    )
    known = (F.col("__action.type") == "STRING") & F.col("__action.value").isin(FEEDBACK_ACTIONS)
    is_object = F.coalesce(F.schema_of_variant("__json").startswith("OBJECT"), F.lit(False))
    problem = (
        F.when(~is_object, F.lit(MALFORMED))
        .when(~is_filled(F.col("__item_id")) | ~is_filled(F.col("__action")), F.lit(MISSING))
        .when(~F.coalesce(known, F.lit(False)), F.lit(UNKNOWN_ACTION))
    )
    return found.select(
        *events.columns,
        *[F.col(f"__{name}.value").alias(name) for name in FIELD_KEYS],
        problem.alias("problem"),
    )


def feedback_log(valid: DataFrame, now: datetime, payload: str = "payload") -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return valid.filter(F.col("problem").isNull()).select(
        F.sha2(F.concat_ws("\n", payload, F.unix_micros(at).cast("string")), 256).alias("id"),
        "item_id",
        "push_event_id",
        "user_id",
        "action",
        F.col(payload).alias("metadata"),
        at.alias("created_at"),
    )


def note_requests(feedback: DataFrame) -> DataFrame:
    """Distinct items whose reader asked for a note."""
    return feedback.filter(F.col("action") == NOTE_ACTION).select("item_id").distinct()
