"""Ingest guards: head of each feed, age, missing link."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.latest import top_n_per_key
from feedloom.operators.skew import left_join_unique

# Default guard limits.
MAX_ITEMS_PER_FEED = 100
MAX_AGE_DAYS = 7


def head_of_feed(
    items: DataFrame, feed: str = "source_url", pos: str = "pos", n: int = MAX_ITEMS_PER_FEED
) -> DataFrame:
    """The first ``n`` entries of each feed in feed order."""
    return top_n_per_key(items, [feed], [F.col(pos)], n, "__rank").drop("__rank")


def head_over_pages(
    items: DataFrame,
    feed: str = "source_url",
    page: str = "landed_seq",
    pos: str = "pos",
    n: int = MAX_ITEMS_PER_FEED,
) -> DataFrame:
    """The first ``n`` entries of each feed over all its pages, in page order; ``pos`` counts from 0 in a page.

    Entries are counted per page, and prefix sums over those counts say how many come before a page,
    so entries are neither sorted nor, with few pages, moved. As each page has an entry, no feed
    needs more than its first ``n`` pages. Pages of a feed that are equal in order are one place:
    each gives its entries up to the same position.
    """
    # no page gives more, so none is a hot key below
    items = items.filter(F.col(pos) < n)
    counts = items.groupBy(feed, page).agg(F.count("*").alias("__entries"))
    first = top_n_per_key(counts, [feed], [F.col(page)], n, "__rank")
    earlier = Window.partitionBy(feed).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__entries").over(earlier), F.lit(0))
    place = F.to_json(F.struct(F.col(feed).alias("feed"), F.col(page).alias("page")))
    offsets = first.withColumn("__before", before).filter(F.col("__before") < n)
    offsets = offsets.select(place.alias("__offset_place"), "__before", "__entries")
    placed = left_join_unique(
        items.withColumn("__place", place), offsets, "__place", "__offset_place", "__entries"
    )
    kept = placed.filter(F.col("__before") + F.col(pos) < n)
    return kept.select(*[F.col(f"`{c}`") for c in items.columns])


def age_guard(
    items: DataFrame,
    now: datetime,
    max_age_days: int = MAX_AGE_DAYS,
    published: str = "published_at",
) -> DataFrame:
    """Entries published within the last days before ``now``, and undated ones."""
    threshold = F.lit(now) - F.make_dt_interval(days=F.lit(max_age_days))
    kind = items.schema[published].dataType
    return items.filter(
        F.col(published).isNull() | (F.col(published) >= threshold.cast(kind))
    )


def drop_empty_url(items: DataFrame, url: str = "url") -> DataFrame:
    return items.filter(F.col(url) != "")

