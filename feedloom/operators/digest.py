"""Digest selection: newest unsent items of the middle score band, overall or per slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.params import digest_limit
from feedloom.operators.latest import latest_per_key, left_join_latest, top_n_per_key
from feedloom.operators.routing import DIGEST_MIN, PUSH_MIN, not_yet_sent, score_band

DIGEST_SUFFIX = ":digest"


def digest_recipient(recipient: str) -> str:
    return f"{recipient}{DIGEST_SUFFIX}"


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def digest_candidates(
    items: DataFrame,
    analyses: DataFrame,
    push_events: DataFrame,
    recipient: str = "dry-run",
    force: bool = False,
    push_min: float = PUSH_MIN,
    digest_min: float = DIGEST_MIN,
) -> DataFrame:
    """Ready items in the digest band that this digest recipient has not received.

    ``items`` has id, status and created_at; ``analyses`` is a log of which the newest row counts.
    """
    ready = items.filter(F.col("status") == "ready")
    newest = [F.col("analyzed_at").desc(), F.col("analysis_id").desc()]
    log = analyses.select(
        F.col("item_id").alias("id"),
        F.col("id").alias("analysis_id"),
        F.col("created_at").alias("analyzed_at"),
        "importance_score",
    )
    scored = left_join_latest(ready, log, "id", newest, ["importance_score"])
    banded = score_band(scored, "importance_score", digest_min, push_min)
    return not_yet_sent(banded, push_events, digest_recipient(recipient), force)


def open_items(
    state: DataFrame,
    items: DataFrame,
    analyses: DataFrame,
    push_events: DataFrame,
    recipient: str,
    push_min: float = PUSH_MIN,
    digest_min: float = DIGEST_MIN,
) -> DataFrame:
    """The items that wait for a digest: those that waited before, and new ones, without what was sent.

    ``state`` is the result of the digest before; the other tables hold only what came since, an
    analysis with its item or for one that waits. The newest analysis of an item counts. An item that
    was sent, in a digest or alone, or that leaves the band, waits no longer.
    """
    came = analyses.select(
        F.col("item_id").alias("id"),
        "importance_score",
        F.col("created_at").alias("analyzed_at"),
        F.col("id").alias("analysis_id"),
    )
    known = items.select("id", "created_at").unionByName(state.select("id", "created_at"))
    known = latest_per_key(known, ["id"], [F.col("created_at")])
    every = came.join(known, "id").select(*state.columns).unionByName(state)
    newest = latest_per_key(every, ["id"], [F.col("analyzed_at").desc(), F.col("analysis_id").desc()])
    banded = score_band(newest, "importance_score", digest_min, push_min)
    heard = F.col("recipient").isin(recipient, digest_recipient(recipient))
    return not_yet_sent(banded, push_events.filter(heard))


def select_digest(candidates: DataFrame, limit: int | str | None = 10) -> DataFrame:
    """The newest items, at most ``limit`` (clamped to 1..20)."""
    return candidates.orderBy(*newest_first()).limit(digest_limit(limit))


def number_lines(selected: DataFrame) -> DataFrame:
    """Add idx from 1; ``selected`` holds at most 20 rows."""
    window = Window.partitionBy(F.lit(1)).orderBy(*newest_first())
    return selected.withColumn("idx", F.row_number().over(window))


def digest_per_slot(
    candidates: DataFrame, slot: str = "slot", limit: int | str | None = 10
) -> DataFrame:
    """The newest items of each slot, numbered by idx."""
    return top_n_per_key(candidates, [slot], newest_first(), digest_limit(limit), "idx")
