"""Landed feed documents (one per row: source_url and body or content) to feed items."""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_datetime
from feedloom.functions.html import with_html_text
from feedloom.functions.rows import row_udf
from feedloom.functions.text import blank_to_null, first_filled, normalize_text, sha256_text, strip_text
from feedloom.operators.stage import compute_once
from feedloom.schemas import FEED_COLUMNS
from feedloom.sources.encodings import WRONG_BYTES, decoded

UNSUPPORTED = "Unsupported feed format"
MALFORMED = "Malformed feed document"
UNKNOWN_NAMESPACE = "Unknown feed namespace"

# Namespaces of the optional content and author elements, and of Atom.
CONTENT_NS = "{http://purl.org/rss/1.0/modules/content/}"
DC_NS = "{http://purl.org/dc/elements/1.1/}"
ATOM_NS = "{http://www.w3.org/2005/Atom}"

_PROLOG = r"(?s)\A\x{feff}?(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*+(?:\[.*?\]\s*+)?>)*+"
_ROOT = _PROLOG + r"<([A-Za-z_][\w.:-]*+)"

# Child elements carry their namespace in front of their name; text is what comes before any markup.
CHILD = "struct<tag:string,text:string,href:string,rel:string,name:string>"
XML_DDL = f"problem string, name string, entries array<struct<children:array<{CHILD}>,payload:map<string,string>>>"
_TEXT = pa.string()
_CHILD = pa.struct([(name, _TEXT) for name in ("tag", "text", "href", "rel", "name")])
_ENTRY = pa.struct([("children", pa.list_(_CHILD)), ("payload", pa.map_(_TEXT, _TEXT))])
XML_KIND = pa.struct([("problem", _TEXT), ("name", _TEXT), ("entries", pa.list_(_ENTRY))])


@dataclass(frozen=True)
class ParsedFeeds:
    items: DataFrame
    rejects: DataFrame


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents from ``path/source_url=<encoded url>/*``, one whole file per row."""
    return _landed_columns(spark.read.format("binaryFile").load(path))


def stream_landed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same layout as a file stream."""
    schema = "path string, modificationTime timestamp, length long, content binary, source_url string"
    reader = spark.readStream.format("binaryFile").schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _landed_columns(reader.load(path))


def _landed_columns(df: DataFrame) -> DataFrame:
    landed_at = F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS")
    return df.select(
        F.col("source_url").cast("string"),
        "content",
        F.concat_ws(" ", landed_at, F.col("_metadata.file_name")).alias("landed_seq"),
    )


def with_landed_columns(landed: DataFrame) -> DataFrame:
    """Documents with ``body``, ``undecodable`` and ``landed_seq``, their arrival order.

    Bytes in ``content`` are decoded; a ``body`` is text already. Rows without an order are equal in it.
    """
    if "body" not in landed.columns:
        landed = decoded(landed)
    optional = {"landed_seq": F.lit(""), "undecodable": F.lit(False)}
    return landed.withColumns({c: v for c, v in optional.items() if c not in landed.columns})


def with_format(landed: DataFrame) -> DataFrame:
    """Add ``format`` (rss, atom or null) by the local name of the root element."""
    root = F.regexp_extract("body", _ROOT, 1)
    kind = F.when(root.endswith("rss"), F.lit("rss")).when(root.endswith("feed"), F.lit("atom"))
    return landed.withColumn("format", kind)


def _xml_reader():
    """UDF from a document to its entries; its code travels with the query, so workers need no package."""
    atom, malformed, unknown = ATOM_NS, MALFORMED, UNKNOWN_NAMESPACE

    def child(element):
        author = element.find(f"{atom}name")
        return {
            "tag": element.tag,
            "text": element.text,
            "href": element.get("href"),
            "rel": element.get("rel"),
            "name": None if author is None else author.text,
        }

    def result(problem=None, name=None, entries=None):
        return {"problem": problem, "name": name, "entries": entries}

    def read(body):
        if body is None:
            return result()
        try:
            root = ElementTree.fromstring(body.lstrip("\ufeff \t\r\n"))
        except (ElementTree.ParseError, ValueError):
            return result(malformed)
        if root.tag.endswith("rss"):
            name, found = root.find("channel/title"), root.findall("channel/item")
        else:
            name, found = root.find(f"{atom}title"), root.findall(f"{atom}entry")
            if not found and any(e.tag.rpartition("}")[2] == "entry" for e in root if isinstance(e.tag, str)):
                return result(unknown)
        entries = []
        for entry in found:
            parts = [e for e in entry if isinstance(e.tag, str)]
            # the last of equal tags wins
            last = {e.tag: e.text for e in parts}
            entries.append({"children": list(map(child, parts)), "payload": list(last.items())})
        return result(None, None if name is None else name.text, entries)

    return row_udf(read, XML_KIND, XML_DDL)


def _text(entry: Column, tag: str) -> Column:
    """Direct text of the first child with that tag."""
    return strip_text(F.get(F.filter(entry["children"], lambda x: x["tag"] == tag), F.lit(0))["text"])


def _rss_entry(entry: Column) -> Column:
    link = normalize_text(_text(entry, "link"))
    return F.struct(
        link.alias("url"),
        normalize_text(first_filled(_text(entry, "title"), link)).alias("title"),
        first_filled(_text(entry, "description"), _text(entry, f"{CONTENT_NS}encoded")).alias("html"),
        blank_to_null(_text(entry, "guid")).alias("external_id"),
        F.coalesce(blank_to_null(_text(entry, "author")), _text(entry, f"{DC_NS}creator")).alias("author"),
        _text(entry, "pubDate").alias("published"),
        entry["payload"].alias("raw_payload"),
    )


def atom_link(children: Column) -> Column:
    """The first link with an address whose relation is alternate (the default)."""
    wanted = F.filter(
        children,
        lambda x: (x["tag"] == f"{ATOM_NS}link")
        & (F.coalesce(x["href"], F.lit("")) != "")
        & (F.coalesce(x["rel"], F.lit("alternate")) == "alternate"),
    )
    return F.coalesce(strip_text(F.get(wanted, F.lit(0))["href"]), F.lit(""))


def _atom_entry(entry: Column) -> Column:
    def text(tag: str) -> Column:
        return _text(entry, f"{ATOM_NS}{tag}")

    link = atom_link(entry["children"])
    author = F.get(F.filter(entry["children"], lambda x: x["tag"] == f"{ATOM_NS}author"), F.lit(0))
    return F.struct(
        link.alias("url"),
        normalize_text(first_filled(text("title"), link)).alias("title"),
        first_filled(text("content"), text("summary")).alias("html"),
        blank_to_null(text("id")).alias("external_id"),
        strip_text(author["name"]).alias("author"),
        first_filled(text("published"), text("updated")).alias("published"),
        entry["payload"].alias("raw_payload"),
    )


def _explode_entries(docs: DataFrame, name: Column, entries: Column, head: int | None) -> DataFrame:
    """One row per entry with a link; ``pos`` counts those entries from 0 in feed order.

    A document with a reject reason gives one row without entry.
    """
    linked = F.filter(entries, lambda e: e["url"] != "")
    if head is not None:
        linked = F.slice(linked, 1, head)
    rejected = F.col("reason").isNotNull()
    staged = compute_once(
        docs,
        {
            "source_name": first_filled(name, F.col("source_url")),
            "detail": F.when(rejected, F.col("body")),
            "__linked": F.when(~rejected, linked).otherwise(F.array(F.lit(None))),
        },
    )
    about = ["source_url", "source_name", "landed_seq", "reason", "detail"]
    rows = staged.select(*about, F.posexplode("__linked").alias("pos", "entry"))
    return rows.select(*about, "pos", "entry.*")


def to_feed_rows(rows: DataFrame) -> DataFrame:
    """Entries with html, external_id and published texts to the common feed item columns."""
    identity = first_filled(F.col("external_id"), F.col("url"), sha256_text("title"))
    shaped = with_html_text(
        rows.withColumns(
            {
                "external_id": normalize_text(identity),
                "published_at": parse_datetime("published"),
            }
        ),
        {"content": "html"},
    )
    return shaped.select(*FEED_COLUMNS, "reason", "detail")


def split_rows(rows: DataFrame) -> ParsedFeeds:
    """Items and rejects of parsed rows."""
    rejects = rows.filter(F.col("reason").isNotNull())
    return ParsedFeeds(
        rows.filter(F.col("reason").isNull()).select(*FEED_COLUMNS),
        rejects.select("source_url", "reason", F.col("detail").alias("body")),
    )


def parse_feed_rows(landed: DataFrame, head: int | None = None) -> DataFrame:
    """RSS and Atom documents to feed item columns; unreadable documents carry a reason instead.

    ``head`` keeps the first entries of each document before they leave the parser, so the
    per-feed limit needs no shuffle.
    """
    typed = with_format(with_landed_columns(landed))
    read = _xml_reader()
    readable = F.col("format").isNotNull() & ~F.col("undecodable")
    docs = compute_once(typed, {"xml": read(F.when(readable, F.col("body")))})
    docs = docs.withColumn(
        "reason",
        F.when(F.col("undecodable"), F.lit(WRONG_BYTES))
        .when(F.col("format").isNull(), F.lit(UNSUPPORTED))
        .otherwise(F.col("xml.problem")),
    )
    found = F.col("xml.entries")
    entries = F.when(F.col("format") == "rss", F.transform(found, _rss_entry)).otherwise(
        F.transform(found, _atom_entry)
    )
    return to_feed_rows(_explode_entries(docs, strip_text("xml.name"), entries, head))


def parse_feeds(landed: DataFrame, head: int | None = None) -> ParsedFeeds:
    return split_rows(parse_feed_rows(landed, head))
