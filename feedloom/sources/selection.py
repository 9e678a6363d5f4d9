"""Source lists: the sample source, configured feeds and their selection."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import split_list
from feedloom.schemas import FEED_ITEM

RSS, READER_FEED, READER_API = "rss", "reader_feed", "reader_api"


def sample_items(spark: SparkSession) -> DataFrame:
    """One fixed feed item for smoke runs."""
    row = (
        "Built-in journal",
        "builtin://journal",
        "journal-0001",
        "https://journal.invalid/2026/index-move",
        "How we moved the search index to a new database without downtime",
        "The journal",
        datetime(2026, 6, 9, 7, 30, tzinfo=timezone.utc),
        "Notes from a quiet week: a Python job copies the index, a small language model checks the answers, "
        "and the old database is switched off last.",
        {"edition": "1"},
        0,
        "",
    )
    return spark.createDataFrame([row], FEED_ITEM)


def configured_sources(config: DataFrame) -> DataFrame:
    """(origin, url, pos) from rows (origin, urls) that hold comma lists."""
    return config.select("origin", F.posexplode(split_list("urls")).alias("pos", "url"))


def select_sources(
    configured: DataFrame, reader_api: bool = False, ad_hoc: DataFrame | None = None
) -> DataFrame:
    """Feeds of one run: an ad-hoc list replaces all; with the reader API its feeds are left out."""
    if ad_hoc is not None:
        return ad_hoc.select("url")
    feeds = [RSS] if reader_api else [RSS, READER_FEED]
    return configured.filter(F.col("origin").isin(feeds)).select("url")


def reader_api_configured(base_url: str, username: str, password: str) -> bool:
    return bool(base_url and username and password)


def union_items(*parts: DataFrame) -> DataFrame:
    """Items of all sources, nothing removed."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
