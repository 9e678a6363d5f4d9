"""The curation tables as views over the given Parquet tables, nothing left out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import sha256_text
from feedloom.operators.analyze import analyze_items
from feedloom.schemas import TABLE_COLUMNS, TABLES
from feedloom.streaming.tables import Batch

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

NOW = datetime(2024, 1, 20)
# Thresholds under which all three routes occur on the documents.
PUSH_MIN, DIGEST_MIN = 0.75, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def start_plus(seconds: Column) -> Column:
    """2024-01-01 plus seconds, as a timestamp without zone."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return base + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def stamp(value: Column) -> Column:
    """Timestamp as text, so that both engines compare the same characters."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: one per document, in arrival order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit(" #"), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"),
            F.col("doc_id").cast("string"),
        ).alias("canonical_url"),
        F.col("source").alias("source_name"),
        "lang",
        "n_chars",
        start_plus(F.col("doc_id") * 60).alias("created_at"),
    )


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_items(items(spark, sf_dir))


def analysis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several analyses per item: the keyword score, then one from the quality label."""
    first = analyzed(spark, sf_dir).select(
        F.lit(1).alias("id"), F.col("id").alias("item_id"), "importance_score", "created_at"
    )
    labels = table(spark, sf_dir, "labels")
    later = labels.select(
        F.lit(2).alias("id"),
        F.col("doc_id").alias("item_id"),
        (F.lit(0.45) + F.lit(0.25) * F.col("quality")).alias("importance_score"),
        start_plus(F.col("doc_id") * 60 + 30).alias("created_at"),
    )
    return first.unionByName(later)


def push_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the delivery log: the user id is the item, the type gives outcome and channel."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.when(kind == "purchase", "dry-run:digest").otherwise("dry-run").alias("recipient"),
        F.when(kind.isin("view", "purchase"), "sent")
        .when(kind == "error", "failed")
        .otherwise("pending")
        .alias("status"),
        F.col("ts").alias("created_at"),
    )


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and a second copy of every page under a decorated address."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "#.*", "")
    joint = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    tracked = F.concat(
        F.replace(bare, F.lit("https://"), F.lit("HTTPS://")), joint,
        F.lit("UTM_medium=rss&gclid="), F.col("page_id").cast("string"), F.lit("#copy"),
    )
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    original = pages.select("page_id", "url", title.alias("title"), F.col("html").alias("raw_content"))
    copy = pages.select(
        (F.col("page_id") + 1_000_000_000_000).alias("page_id"),
        tracked.alias("url"),
        title.alias("title"),
        F.col("html").alias("raw_content"),
    )
    return original.unionByName(copy)


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a shared-address key and a text hash, so that chains over both occur."""
    return items(spark, sf_dir).select(
        "id",
        "created_at",
        F.concat_ws("/", "source_name", "lang", F.col("n_chars").cast("string")).alias("url"),
        sha256_text("content").alias("hash"),
    )


def landed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feeds in bytes, one entry each; the language decides how they are encoded."""
    docs = table(spark, sf_dir, "documents")
    latin = F.regexp_replace("text", r"[^\x{20}-\x{7e}\x{a0}-\x{ff}\n]", "?")
    safe = F.replace(F.replace(latin, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number = F.col("doc_id").cast("string")
    items = F.concat(
        F.lit("<rss><channel><title>F\u00e9ed</title><item><link>https://e.org/"), number, F.lit("</link><description>"),
        safe, F.lit("</description></item></channel></rss>"),
    )
    declared = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>'), items)
    content = (
        F.when(F.col("lang") == "en", F.encode(items, "UTF-16"))
        .when(F.col("lang") == "fr", F.encode(declared, "ISO-8859-1"))
        .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("EFBBBF")), F.encode(items, "UTF-8")))
        .otherwise(F.concat(F.encode(items, "UTF-8"), F.unhex(F.lit("FF"))))
    )
    return docs.select(F.concat(F.lit("https://e.org/"), number, F.lit("/feed")).alias("source_url"), content.alias("content"))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items; equal texts of a source have one title and differ in their address."""
    rows = items(spark, sf_dir)
    none = F.lit(None)
    return rows.select(
        "source_name",
        F.concat(F.lit("https://"), "source_name", F.lit(".example.org/feed")).alias("source_url"),
        F.col("id").cast("string").alias("external_id"),
        F.col("canonical_url").alias("url"),
        F.col("source_name").alias("title"),
        none.cast("string").alias("author"),
        none.cast("timestamp").alias("published_at"),
        "content",
        none.cast("map<string,string>").alias("raw_payload"),
        (F.col("id") % 3).cast("int").alias("pos"),
        F.lpad(F.col("id").cast("string"), 20, "0").alias("landed_seq"),
    )


def write_logs(spark: SparkSession, sf_dir: str, batch: Batch) -> None:
    """Items, raw items, sources, analyses and deliveries of the fixture as one batch of the pipeline's logs."""
    own = {c: F.col(c).cast("timestamp") for c in ("created_at",)}
    rows = items(spark, sf_dir).withColumns({**own, "key": F.col("id").cast("string")})
    empty = F.lit(None)

    def write(table_name: str, frame: DataFrame) -> None:
        kinds = dict(part.split()[:2] for part in TABLES[table_name].replace("\n", " ").split(", "))
        missing = {c: empty.cast(kinds[c]) for c in TABLE_COLUMNS[table_name] if c not in frame.columns}
        batch.write(table_name, frame.withColumns(missing))

    source = sha256_text("source_name").alias("source_id")
    write("items", rows.select(F.col("key").alias("id"), F.col("key").alias("raw_item_id"), "title", "content", "canonical_url", "created_at"))
    write("raw_items", rows.select(F.col("key").alias("id"), source, F.lit(True).alias("created"), "created_at"))
    write("sources", rows.select(sha256_text("source_name").alias("id"), F.col("source_name").alias("name")).distinct())
    log = analysis_log(spark, sf_dir).withColumns(
        {
            "id": F.col("id").cast("string"),
            "item_id": F.col("item_id").cast("string"),
            "importance_score": F.col("importance_score").cast("decimal(4,3)"),
            **own,
        }
    )
    write("analysis_results", log)
    write("push_events", push_log(spark, sf_dir).withColumns({"item_id": F.col("item_id").cast("string"), **own}))
    batch.done(NOW)


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))


def feedback_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback callbacks; the event type decides where the fields sit."""
    item = F.col("user_id").cast("string")
    kind = F.col("event_type")
    top = F.to_json(F.struct(item.alias("item_id"), F.lit("useful").alias("action")))
    nested = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    item.alias("itemId"),
                    F.lit("save_obsidian").alias("action"),
                    F.col("event_id").alias("push_event_id"),
                ).alias("value")
            ).alias("action")
        )
    )
    in_event = F.to_json(
        F.struct(
            F.struct(
                item.alias("item_id"), F.lit("read_later").alias("value"), item.alias("open_id")
            ).alias("event")
        )
    )
    unknown = F.to_json(F.struct(item.alias("itemId"), F.lit("explode").alias("value")))
    payload = (
        F.when(kind == "view", top)
        .when(kind == "click", nested)
        .when(kind == "purchase", in_event)
        .when(kind == "error", unknown)
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))


def landed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a small feed: RSS, Atom, an unknown root or broken markup by language."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    link = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), number)
    body = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    odd = F.col("doc_id") % 2 == 1
    c, d = F.when(odd, "c").otherwise("content"), F.when(odd, "d").otherwise("dc")
    rss = F.concat(
        F.lit('<?xml version="1.0"?>\n<rss version="2.0" xmlns:'), d, F.lit('="http://purl.org/dc/elements/1.1/" xmlns:'),
        c, F.lit('="http://purl.org/rss/1.0/modules/content/" xmlns:m="urn:media"><channel><title>Feed '),
        F.col("source"), F.lit("</title><item><title>no link</title></item><item><title>T "), number,
        F.lit("<b>bold</b> tail</title><m:credit>Eve</m:credit><link> "), link, F.lit('</link><guid isPermaLink="false">g'), number,
        F.lit("</guid><pubDate>Wed, 10 Jan 2024 12:00:00 +0800</pubDate><description>"), body,
        F.lit("</description></item><item><link>"), link, F.lit("/b</link><"), d, F.lit(":creator>Ann</"), d,
        F.lit(":creator><"), c, F.lit(":encoded><![CDATA[<p>short <a:b> </p>]]></"), c, F.lit(":encoded></item></channel></rss>"),
    )
    plain_atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed '), F.col("source"),
        F.lit('</title><entry><title>T '), number,
        F.lit('</title><link rel="self" href="https://x.org/self"/><link href="'), link,
        F.lit('"/><id>g'), number,
        F.lit("</id><updated>2024-01-10T12:00:00Z</updated><author><name>Bob</name></author>"
              '<summary type="html">'), body, F.lit("</summary></entry></feed>"),
    )
    prefixed = F.replace(F.regexp_replace(plain_atom, "<(/?)(?=[a-z])", "<$1a:"), F.lit(" xmlns="), F.lit(" xmlns:a="))
    atom = F.when(odd, prefixed).otherwise(plain_atom)
    lang = F.col("lang")
    text = (
        F.when(lang == "en", rss)
        .when(lang == "fr", atom)
        .when(lang == "de", F.concat(F.lit("<opml><body>"), body, F.lit("</body></opml>")))
        .otherwise(F.concat(F.lit("<rss><channel><item>"), body))
    )
    return docs.select(link.alias("source_url"), text.alias("body"))


def landed_reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one reader-API page of three entries, one of them without address."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    link = F.concat(F.lit("https://example.org/"), number)
    href = F.struct(link.alias("href"))
    full = F.to_json(
        F.struct(
            F.concat(F.lit("tag:"), number).alias("id"),
            F.concat(F.lit("T  "), number).alias("title"),
            F.lit("Ada").alias("author"),
            F.lit("@time").alias("published"),
            F.array(href).alias("canonical"),
            F.struct(F.col("text").alias("content")).alias("summary"),
            F.struct(F.col("source").alias("title")).alias("origin"),
        )
    )
    # a number, or a text, which is no time and hides no later one
    time = F.when(F.col("lang") == "fr", F.lit('"abc", "updated": 1704067200, "none": null')).otherwise(
        (F.lit(1704067200) + F.col("doc_id")).cast("string")
    )
    full = F.replace(full, F.lit('"@time"'), time)
    alternate = F.to_json(
        F.struct(
            F.concat(F.lit("alt:"), number).alias("id"),
            F.lit(0).alias("published"),
            (F.lit(1704067200) + F.col("n_chars")).alias("updated"),
            F.array(F.struct(F.lit("").alias("href")), F.struct(F.concat(link, F.lit("/alt ")).alias("href"))).alias("alternate"),
            F.struct(F.lit("<p>Hi <b>you</b></p>").alias("content")).alias("content"),
        )
    )
    body = F.concat(F.lit('{"items": ['), full, F.lit(', {"title": "no address"}, '), alternate, F.lit("]}"))
    return docs.select(
        F.lit("https://reader.example.org/api/").alias("source_url"),
        F.when(F.col("lang") == "es", F.lit("<html>error</html>")).otherwise(body).alias("body"),
    )
