"""Landed reader-API pages (JSON: source_url, body) to feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import epoch_datetime
from feedloom.functions.html import with_html_text
from feedloom.functions.params import clamp
from feedloom.functions.payload import string_map
from feedloom.functions.text import blank_to_null, first_filled, normalize_text, sha256_text, strip_text
from feedloom.operators.stage import compute_once
from feedloom.schemas import FEED_COLUMNS
from feedloom.sources.encodings import WRONG_BYTES
from feedloom.sources.feeds import ParsedFeeds, split_rows, with_landed_columns

MALFORMED = "Malformed reader page"

ENTRY_DDL = """
id string, title string, author string, published variant, updated variant,
canonical array<struct<href:string>>, alternate array<struct<href:string>>,
summary struct<content:string>, content struct<content:string>, origin struct<title:string>
"""


def page_size(limit: int | str | None) -> int:
    return clamp(limit, default=50, low=1, high=200)


def _first_href(links: Column) -> Column:
    filled = F.filter(links, lambda x: F.coalesce(x["href"], F.lit("")) != "")
    return F.get(filled, F.lit(0))["href"]


def entry_url(entry: Column) -> Column:
    """First canonical address, else first alternate one, else the id."""
    found = F.coalesce(
        _first_href(entry["canonical"]), _first_href(entry["alternate"]), entry["id"], F.lit("")
    )
    return strip_text(found)


def entry_html(entry: Column) -> Column:
    return first_filled(entry["content"]["content"], entry["summary"]["content"])


def parse_reader_rows(landed: DataFrame, head: int | None = None) -> DataFrame:
    """Entries with an address, in page order; pages that are not JSON objects carry a reason."""
    pages = compute_once(
        with_landed_columns(landed),
        {"page": F.from_json("body", "items array<string>, _corrupt_record string")},
    )
    wrong = F.when(F.col("undecodable"), F.lit(WRONG_BYTES)).otherwise(F.lit(MALFORMED))
    bad = F.col("undecodable") | F.col("page").isNull() | F.col("page._corrupt_record").isNotNull()
    entries = F.transform(
        F.coalesce("page.items", F.array()),
        lambda text: F.struct(F.from_json(text, ENTRY_DDL).alias("entry"), text.alias("text")),
    )
    linked = F.filter(entries, lambda x: entry_url(x["entry"]) != "")
    if head is not None:
        linked = F.slice(linked, 1, head)
    staged = compute_once(
        pages,
        {
            "reason": F.when(bad, wrong),
            "detail": F.when(bad, F.col("body")),
            "__linked": F.when(~bad, linked).otherwise(F.array(F.lit(None))),
        },
    )
    about = [F.regexp_replace("source_url", "/+$", "").alias("source_url"), "landed_seq", "reason", "detail"]
    rows = staged.select(*about, F.posexplode("__linked").alias("pos", "x"))
    entry = F.col("entry")
    rows = rows.select("*", "x.entry", "x.text").withColumn("url", entry_url(entry))
    rows = rows.withColumn("title", normalize_text(first_filled(entry["title"], F.col("url"))))
    identity = first_filled(entry["id"], F.col("url"), sha256_text("title"))
    shaped = rows.withColumns(
        {
            "source_name": first_filled(entry["origin"]["title"], F.col("source_url")),
            "external_id": normalize_text(identity),
            "author": blank_to_null(entry["author"]),
            "published_at": epoch_datetime(entry["published"], entry["updated"]),
            "raw_payload": string_map(F.col("text")),
            "html": entry_html(entry),
        }
    )
    return with_html_text(shaped, {"content": "html"}).select(*FEED_COLUMNS, "reason", "detail")


def parse_reader_pages(landed: DataFrame, head: int | None = None) -> ParsedFeeds:
    return split_rows(parse_reader_rows(landed, head))
