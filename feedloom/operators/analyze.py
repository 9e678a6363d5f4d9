"""Normalize and analyze items set-at-a-time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.scoring import (
    TOPIC_KEYWORDS,
    keyword_analysis,
    matched_topics,
    search_text,
    summarize_normalized,
)
from feedloom.functions.text import bind, content_hash, normalize_text
from feedloom.functions.urls import canonicalize_url
from feedloom.operators.stage import compute_once

Analyzer = Callable[[Column, Column, Column], Column]


def normalize_items(raw: DataFrame) -> DataFrame:
    """Add canonical_url, content and normalized_hash to rows with url, title and raw_content."""
    staged = compute_once(raw, {"canonical_url": canonicalize_url("url")})
    staged = staged.withColumn("content", normalize_text("raw_content"))
    return staged.withColumn("normalized_hash", content_hash("title", "canonical_url", "content"))


def analyze_items(
    items: DataFrame,
    lexicon: dict[str, list[str]] = TOPIC_KEYWORDS,
    analyzer: Analyzer = keyword_analysis,
    content_normalized: bool = False,
) -> DataFrame:
    """Add the analyzer's result columns to rows with title and content.

    ``analyzer`` maps (topics, text length, summary) to a result struct, so another scorer can
    take its place. The keyword scan runs once per row, whatever is filtered or selected later.
    """
    content = F.col("content") if content_normalized else normalize_text("content")
    staged = items.withColumns({"__title": normalize_text("title"), "__content": content})

    def match(text: Column) -> Column:
        return F.struct(
            matched_topics(text, lexicon).alias("topics"), F.length(text).alias("chars")
        )

    text = search_text(F.col("__title"), F.col("__content"))
    staged = compute_once(staged, {"__match": bind(text, match)})
    summary = summarize_normalized(F.col("__title"), F.col("__content"))
    result = analyzer(F.col("__match.topics"), F.col("__match.chars"), summary)
    return staged.withColumn("__result", result).select(*items.columns, "__result.*")
