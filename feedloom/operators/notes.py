"""Markdown notes: path, text and partitioned export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.slots import DEFAULT_ZONE, local_time
from feedloom.functions.text import slugify

DEFAULT_ROOT = "notes"


def _quoted(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), _quoted(F.coalesce(value, F.lit(""))))


def note_markdown(day: Column) -> Column:
    title = F.coalesce(F.col("title"), F.lit(""))
    url = F.coalesce(F.col("canonical_url"), F.lit(""))
    return F.concat_ws(
        "\n",
        F.lit("---"),
        _line("source", F.col("source_name")),
        _line("url", F.col("canonical_url")),
        _line("published", F.date_format(day, "yyyy-MM-dd")),
        _line("item_id", F.col("id").cast("string")),
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit("# "), title),
        F.lit(""),
        F.lit("## Summary"),
        F.lit(""),
        F.coalesce(F.col("summary"), F.lit("")),
        F.lit(""),
        F.lit("## Original"),
        F.lit(""),
        F.concat(url, F.lit("\n")),
    )


def build_notes(
    items: DataFrame, now: datetime, root: str = DEFAULT_ROOT, zone: str = DEFAULT_ZONE
) -> DataFrame:
    """(item_id, year, month, path, markdown) per item.

    Needs id, title, canonical_url, summary, source_name and published_at. Every path carries a
    short id, so that an item has the same path in any batch and none overwrites another.
    """
    published = F.coalesce(F.col("published_at"), F.lit(now).cast(items.schema["published_at"].dataType))
    staged = items.withColumn("__day", local_time(published, zone)).withColumns(
        {
            "year": F.date_format("__day", "yyyy"),
            "month": F.date_format("__day", "MM"),
            "item_id": F.col("id").cast("string"),
        }
    )
    name = F.concat_ws("-", slugify("title"), F.substring(F.sha2("item_id", 256), 1, 12))
    path = F.concat(F.concat_ws("/", F.lit(root), "year", "month", name), F.lit(".md"))
    return staged.select(
        "item_id", "year", "month", path.alias("path"), note_markdown(F.col("__day")).alias("markdown")
    )


def note_log(notes: DataFrame, now: datetime) -> DataFrame:
    return notes.select(
        F.sha2("item_id", 256).alias("id"),
        "item_id",
        "path",
        "markdown",
        F.lit("written").alias("status"),
        F.lit(now).cast("timestamp").alias("updated_at"),
    )
