"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import cards, dates, params, payload, scoring, slots, text, urls
from feedloom.functions.html import with_html_text
from feedloom.operators import checks, dedupe, digest, feedback, groups, ingest, language, latest, messages, notes, novelty, retry, routing, upsert
from feedloom.operators.analyze import normalize_items
from feedloom.operators.skew import left_join_unique
from feedloom.plans import fixtures as fx
from feedloom.session import materialize, shared_dir
from feedloom.sources.feeds import parse_feed_rows, parse_feeds
from feedloom.sources.reader import parse_reader_pages
from feedloom.sources.selection import sample_items, union_items
from feedloom.streaming import compaction, pipeline
from feedloom.streaming.tables import Batch, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# ---- sources -------------------------------------------------------------------------------


@query
def rss_atom_scan(spark, sf_dir):
    found = parse_feeds(fx.landed_feeds(spark, sf_dir)).items
    return found.select(
        "source_url", "source_name", "external_id", "url", "title", "author", "content", "pos",
        fx.stamp(F.col("published_at")).alias("published"),
        F.array_join(
            F.transform(
                F.sort_array(F.map_entries("raw_payload")),
                lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null"))),
            ),
            "|",
        ).alias("payload"),
    )


@query
def feed_rejects(spark, sf_dir):
    found = parse_feeds(fx.landed_feeds(spark, sf_dir)).rejects
    return found.select("source_url", "reason", F.length("body").alias("n_chars"))


@query
def feed_encodings(spark, sf_dir):
    found = parse_feed_rows(fx.landed_bytes(spark, sf_dir))
    return found.select("source_url", "source_name", "url", "content", "reason", F.length("detail").alias("n_chars"))


@query
def reader_scan(spark, sf_dir):
    found = parse_reader_pages(fx.landed_reader_pages(spark, sf_dir)).items
    return found.select(
        "source_url", "source_name", "external_id", "url", "title", "author", "content", "pos",
        fx.stamp(F.col("published_at")).alias("published"),
        F.size("raw_payload").alias("n_keys"),
        F.element_at("raw_payload", "origin").alias("origin"),
        F.element_at("raw_payload", "none").alias("none"),
    )


@query
def payload_map(spark, sf_dir):
    props = F.regexp_replace("props", r"\}\s*$", ', "none": null}')
    events = fx.table(spark, sf_dir, "events").withColumn("m", payload.string_map(props))
    return events.select(
        "event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n_keys"), F.col("m")["none"].alias("none")
    )


@query
def split_list(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").withColumn("parts", text.split_list("text"))
    return docs.select("doc_id", F.size("parts").alias("n_parts"), F.array_join("parts", "|").alias("parts"))


@query
def union_sources(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    pages = fx.table(spark, sf_dir, "pages")
    return union_items(
        docs.select(F.lit("reader").alias("origin"), F.col("doc_id").alias("id"), F.col("source").alias("feed")),
        pages.select(F.lit("rss").alias("origin"), F.col("page_id").alias("id"), fx.host("url").alias("feed")),
    )


@query
def table_inventory(spark, sf_dir):
    return checks.table_inventory({n: fx.table(spark, sf_dir, n) for n in fx.TABLE_NAMES})


@query
def sample_with_documents(spark, sf_dir):
    """The built-in item next to one item per document."""
    docs = fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("external_id"),
        F.concat(F.lit("T "), F.col("doc_id").cast("string")).alias("title"), F.length("text").alias("n_chars"),
    )
    sample = sample_items(spark).select("source_name", "external_id", "title", F.length("content").alias("n_chars"))
    return union_items(sample, docs)


@query
def missing_tables(spark, sf_dir):
    """Required tables that hold no row, or are not there."""
    found = checks.table_inventory({n: fx.table(spark, sf_dir, n) for n in fx.TABLE_NAMES})
    required = spark.createDataFrame([(n,) for n in [*fx.TABLE_NAMES, "archive", "ledger"]], "table_name string")
    return checks.missing_keys(required, found.filter("n_rows > 0").select("table_name"))


# ---- sinks ---------------------------------------------------------------------------------


@query
def upsert_latest_source(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select(
        fx.host("url").alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"),
        F.col("page_id").alias("seq"),
    )
    return latest.latest_per_key(pages, ["url"], [F.col("seq").desc()])


@query
def upsert_raw_merge(spark, sf_dir):
    versions = fx.table(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", "event_id",
        F.col("event_id").alias("url"), fx.stamp(F.col("ts")).alias("created_at"),
        F.col("value").alias("content"), "props",
    )
    return upsert.merge_first_last(
        versions,
        ["user_id", "event_type"],
        ["ts", "event_id"],
        ["url", "created_at"],
        ["content", "props"],
    )


@query
def note_upsert(spark, sf_dir):
    """The newest note per item of a log by two writers."""
    log = fx.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("item_id"),
        F.concat(F.lit("notes/"), "event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit("written").alias("status"),
        F.date_trunc("DAY", "ts").alias("updated_at"),
        F.when(F.col("event_id") % 2 == 0, "feedback").otherwise("notes").alias("writer"),
        F.col("event_id").alias("batch_id"),
    )
    return pipeline.current_notes(log).select("item_id", "path", "status", fx.stamp(F.col("updated_at")).alias("updated_at"))


@query
def raw_url_conflicts(spark, sf_dir):
    entries = fx.raw_entries(spark, sf_dir).select(
        "page_id", fx.host("url").alias("source_id"), urls.canonicalize_url("url").alias("url")
    )
    flagged = upsert.flag_key_conflicts(entries, ["source_id", "url"], "page_id", [])
    return flagged.select("page_id", "url", "conflict")


@query
def normalize_insert_absent(spark, sf_dir):
    landed = normalize_items(fx.raw_entries(spark, sf_dir))
    existing = fx.table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("utm_source")))
    existing = existing.select(urls.canonicalize_url("url").alias("canonical_url"))
    fresh = upsert.insert_if_absent(landed, existing, ["canonical_url"], [F.col("page_id")])
    return fresh.select("page_id", "canonical_url", "title", "normalized_hash")


@query
def push_event_log(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").withColumn("id", F.col("event_id"))
    failed = F.when(F.col("event_type") == "error", F.lit("timeout"))
    log = messages.delivery_events(events, "dry-run", fx.NOW, error=failed)
    return log.select(
        "item_id", "channel", "recipient", "message_id", "status", "last_error",
        fx.stamp(F.col("sent_at")).alias("sent_at"),
    )


@query
def note_export(spark, sf_dir):
    docs = fx.items(spark, sf_dir).withColumn("summary", scoring.summarize("title", "content"))
    docs = docs.withColumn("title", F.concat_ws(" ", "source_name", "lang"))
    labels = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    chosen = docs.join(labels, "id").withColumn(
        "published_at", F.when(F.col("toxic") == 0, F.col("created_at"))
    )
    return notes.build_notes(chosen, fx.NOW).select("item_id", "year", "month", "path", "markdown")


def _card_items(spark, sf_dir):
    """Analyzed documents whose summary carries link labels, as reader feeds do."""
    link = F.concat(F.lit("https://news.example.org/item?id="), F.col("id").cast("string"))
    label = F.when(F.col("lang") == "en", F.lit("Article")).otherwise(F.lit("Comments"))
    tail = F.concat(F.lit("<p>"), label, F.lit(' URL: <a href="'), link, F.lit('">'), link, F.lit(").</a></p>"))
    return fx.analyzed(spark, sf_dir).withColumn("summary", F.concat("summary", F.lit(" "), tail))


@query
def push_card(spark, sf_dir):
    built = cards.with_push_card(_card_items(spark, sf_dir))
    names = [c for c in built.columns if c.startswith("card")]
    return built.select("id", *names)


def _digest_candidates(spark, sf_dir, items=None):
    docs = _card_items(spark, sf_dir).drop("importance_score") if items is None else items
    return digest.digest_candidates(
        docs.withColumn("status", F.lit("ready")),
        fx.analysis_log(spark, sf_dir),
        fx.push_log(spark, sf_dir),
        push_min=fx.PUSH_MIN,
        digest_min=fx.DIGEST_MIN,
    )


@query
def digest_lines(spark, sf_dir):
    chosen = digest.number_lines(digest.select_digest(_digest_candidates(spark, sf_dir)))
    return cards.with_digest_line(chosen).select("idx", "id", "line")


@query
def digest_card(spark, sf_dir):
    chosen = digest.number_lines(digest.select_digest(_digest_candidates(spark, sf_dir)))
    return cards.digest_card(cards.with_digest_line(chosen))


@query
def status_derivation(spark, sf_dir):
    rows = fx.duplicate_rows(spark, sf_dir)
    links = dedupe.duplicate_parents(rows, "url", "hash")
    docs = links.select("id", F.col("parent_id").isNotNull().alias("is_duplicate"))
    newest = latest.latest_per_key(
        fx.analysis_log(spark, sf_dir), ["item_id"], [F.col("created_at").desc(), F.col("id").desc()]
    )
    return routing.with_status(
        docs, newest, fx.push_log(spark, sf_dir), "dry-run", fx.PUSH_MIN, fx.DIGEST_MIN
    )


# ---- projections, filters, predicates --------------------------------------------------------


@query
def age_guard(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").withColumn(
        "published_at", F.when(F.col("event_type") != "signup", F.col("ts"))
    )
    return ingest.age_guard(events, fx.NOW).select("event_id", "event_type")


@query
def drop_empty_url(spark, sf_dir):
    link = F.when(F.col("url").startswith("https://"), F.col("url")).otherwise(F.lit(""))
    pages = fx.table(spark, sf_dir, "pages").select("page_id", link.alias("url"))
    return ingest.drop_empty_url(pages)


@query
def positive_int(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    value = params.positive_int(F.get_json_object("props", "$.k"), 7)
    return events.select("event_id", value.alias("n"))


@query
def clamp_limit(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k")
    return events.select(
        "event_id",
        params.clamp_int(key, 10, 1, 20).alias("digest_limit"),
        params.clamp_int(F.concat(key, F.lit("0")), 50, 1, 200).alias("page_size"),
        params.clamp_int(F.col("event_type"), 10, 1, 20).alias("fallback"),
    )


@query
def score_band(spark, sf_dir):
    return routing.score_band(fx.table(spark, sf_dir, "events"), "value", 50, 150).select("event_id", "value")


@query
def past_stage_skip(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return routing.past_stage_skip(orders, "o_orderstatus", ["F"]).select("o_orderkey", "o_orderstatus")


@query
def feedback_validate(spark, sf_dir):
    found = feedback.feedback_fields(fx.feedback_payloads(spark, sf_dir))
    return found.select("event_id", F.coalesce("problem", F.lit("accepted")).alias("outcome"))


@query
def feedback_fields(spark, sf_dir):
    found = feedback.feedback_fields(fx.feedback_payloads(spark, sf_dir))
    return found.select("event_id", "item_id", "action", "push_event_id", "user_id")


@query
def note_requests(spark, sf_dir):
    found = feedback.feedback_fields(fx.feedback_payloads(spark, sf_dir))
    return feedback.note_requests(feedback.feedback_log(found, fx.NOW))


@query
def push_skip(spark, sf_dir):
    return routing.not_yet_sent(fx.items(spark, sf_dir).select("id"), fx.push_log(spark, sf_dir))


# ---- joins -----------------------------------------------------------------------------------


@query
def join_item_raw_source(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    raw = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sources = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    named = left_join_unique(raw, sources, "o_custkey", "c_custkey").filter(F.col("c_name").isNotNull())
    return items.join(named, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query
def latest_per_key_left(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = fx.table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return latest.left_join_latest(
        customers,
        orders,
        "c_custkey",
        [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
        ["o_orderkey", "o_totalprice"],
    )


@query
def not_yet_sent_anti(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return routing.not_yet_sent(customers, fx.push_log(spark, sf_dir), "dry-run:digest")


@query
def exists_semi(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(fx.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query
def dedupe_parent(spark, sf_dir):
    return dedupe.duplicate_parents(fx.duplicate_rows(spark, sf_dir), "url", "hash").select("id", "parent_id")


@query
def new_keys_anti(spark, sf_dir):
    batch = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    existing = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"))
    return upsert.unseen(batch, existing, ["conv_id"])


@query
def in_subquery_semi(spark, sf_dir):
    chosen = fx.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


# ---- aggregations, windows, set operations -----------------------------------------------------


@query
def distinct_canonical_url(spark, sf_dir):
    entries = fx.raw_entries(spark, sf_dir).select(urls.canonicalize_url("url").alias("canonical_url"), "page_id")
    return entries.groupBy("canonical_url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_copies"))


@query
def dedupe_groups(spark, sf_dir):
    return dedupe.dedupe_groups(fx.duplicate_rows(spark, sf_dir), "url", "hash").select("id", "group_id", "status")


@query
def feed_head_n_then_age(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role",
        F.when(F.col("role") != "system", fx.start_plus(F.col("conv_id") * 7200)).alias("published_at"),
    )
    head = ingest.head_of_feed(turns, "conv_id", "turn", 3)
    return ingest.age_guard(head, fx.NOW).select("conv_id", "turn", "role")


@query
def feed_head_over_pages(spark, sf_dir):
    words = F.posexplode(F.split("text", " ")).alias("pos", "entry")
    entries = fx.table(spark, sf_dir, "documents").select("source", "doc_id", words)
    return ingest.head_over_pages(entries, "source", "doc_id", "pos", 100)


@query
def check_batch(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    stored = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"))
    rules = checks.Constraints(
        not_null=["value"],
        domains={"event_type": ["view", "click", "purchase"]},
        references={"user_id": (fx.table(spark, sf_dir, "customer"), "c_custkey")},
        unique=["user_id"],
        order=["ts", "event_id"],
    )
    return checks.check_batch(events, rules, stored).select("event_id", "user_id", "refused")


@query
def latest_analysis(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    newest = latest.latest_per_key(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.drop("ts")


@query
def digest_select(spark, sf_dir):
    """Flagship: newest unsent items in the digest band, by their latest score."""
    items = fx.items(spark, sf_dir).drop("content")
    chosen = digest.select_digest(_digest_candidates(spark, sf_dir, items))
    return chosen.select("id", "title", "canonical_url", "source_name", "importance_score")


@query
def digest_backlog(spark, sf_dir):
    items = fx.items(spark, sf_dir).drop("content")
    waiting = _digest_candidates(spark, sf_dir, items)
    return waiting.groupBy("source_name").agg(F.count("*").alias("n_waiting"))


@query
def except_keys(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return checks.missing_keys(docs, fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


# ---- scalar functions ----------------------------------------------------------------------


def _documents_with(name, function):
    def build(spark, sf_dir):
        docs = fx.table(spark, sf_dir, "documents")
        return docs.select("doc_id", function(F.col("text")).alias(name))

    build.__name__ = name
    return query(build)


_documents_with("normalize_text", text.normalize_text)
_documents_with("sha256_text", text.sha256_text)
_documents_with("truncate_text", lambda c: text.truncate_text(c, 100))
_documents_with("slugify", text.slugify)


@query
def canonical_url(spark, sf_dir):
    entries = fx.raw_entries(spark, sf_dir)
    return entries.select("page_id", urls.canonicalize_url("url").alias("canonical_url"))


@query
def html_to_text(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "html")
    return with_html_text(pages, {"html_to_text": "html"}).drop("html")


@query
def content_hash(spark, sf_dir):
    entries = fx.raw_entries(spark, sf_dir)
    return entries.select("page_id", text.content_hash("title", "url", "raw_content").alias("content_hash"))


@query
def normalized_hash(spark, sf_dir):
    return normalize_items(fx.raw_entries(spark, sf_dir)).select("page_id", "normalized_hash")


@query
def parse_datetime(spark, sf_dir):
    """Each event's time in one of twelve shapes; three of them cannot be read."""
    ts, text = F.date_trunc("SECOND", "ts"), F.lit
    day, clock = F.date_format(ts, "EEE, d MMM yyyy "), F.date_format(ts, "HH:mm:ss")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd"), text("T"), clock)
    shapes = [
        F.concat(day, clock, text(" GMT")),
        F.concat(day, clock, text(" +0800")),
        F.concat(iso, text("Z")),
        F.concat(iso, text("-05:30")),
        F.concat(text("on "), iso),
        F.concat(F.date_format(ts, "EEEE, MMMM d, yyyy "), clock, text(" -0700")),
        F.concat(F.date_format(ts, "EEE MMM d "), clock, F.date_format(ts, " yyyy")),
        F.concat(day, F.replace(clock, text(":"), text(".")), text(" UT")),
        F.concat(day, clock, text(" +08:00")),
        F.concat(F.date_format(ts, "EEE MMM d "), clock, F.date_format(ts, "' +0200' yyyy")),
        F.concat(iso, text("z")),
        day,
    ]
    events = fx.table(spark, sf_dir, "events")
    written = F.get(F.array(*shapes), (F.col("event_id") % len(shapes)).cast("int"))
    return events.select("event_id", fx.stamp(dates.parse_datetime(written)).alias("published"))


@query
def card_text(spark, sf_dir):
    plain = with_html_text(_card_items(spark, sf_dir).select("id", "summary"), {"plain": "summary"})
    return plain.select("id", cards.text_without_urls(F.col("plain")).alias("card_text"))


@query
def comments_url(spark, sf_dir):
    plain = with_html_text(_card_items(spark, sf_dir).select("id", "summary"), {"plain": "summary"})
    return plain.select("id", cards.discussion_link(F.col("plain")).alias("comments_url"))


@query
def card_template(spark, sf_dir):
    score = F.when(F.col("event_type") != "signup", F.col("value") / 200)
    events = fx.table(spark, sf_dir, "events")
    return events.select("event_id", cards.card_template(score).alias("template"))


@query
def topic_match(spark, sf_dir):
    docs = fx.analyzed(spark, sf_dir)
    return docs.select("id", F.array_join("topics", ",").alias("topics"))


@query
def importance_score(spark, sf_dir):
    return fx.analyzed(spark, sf_dir).select("id", "importance_score")


@query
def summary(spark, sf_dir):
    docs = fx.items(spark, sf_dir)
    return docs.select("id", scoring.summarize("title", "content").alias("summary"))


# ---- pipeline steps ------------------------------------------------------------------------


@query
def digest_slot(spark, sf_dir):
    local = slots.local_time(F.col("ts"))
    events = fx.table(spark, sf_dir, "events").select("event_id", local.alias("local"))
    minutes = slots.schedule_times("17:30, 09:00, bad, 9:00")
    return events.select("event_id", fx.stamp(slots.next_slot(F.col("local"), minutes)).alias("slot"))


@query
def digest_per_slot_top_n(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), slots.local_time(F.col("ts")).alias("local")
    )
    slotted = events.withColumn("slot", slots.next_slot(F.col("local"), slots.schedule_times()))
    chosen = digest.digest_per_slot(slotted, limit=10)
    return chosen.select(fx.stamp(F.col("slot")).alias("slot"), "idx", "id")


@query
def ingest_new_items(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select(
        "page_id", "url", "html",
        fx.host("url").alias("source_url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(~F.contains("url", F.lit("#")), fx.start_plus(F.col("page_id") * 3600)).alias("published_at"),
    )
    head = ingest.head_of_feed(pages, "source_url", "page_id", 5)
    recent = ingest.age_guard(head, fx.NOW, 15)
    landed = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    fresh = with_html_text(upsert.unseen(recent, landed, ["page_id"]), {"content": "html"})
    return fresh.select(
        "page_id", "source_url", "title", text.content_hash("title", "url", "content").alias("content_hash")
    )


@query
def analyze_items(spark, sf_dir):
    docs = fx.analyzed(spark, sf_dir)
    return docs.select(
        "id", "model_name", "summary", F.array_join("tags", ",").alias("tags"), "importance_score",
        "novelty_score", "recommended_action", "reason", "raw_output",
    )


@query
def route(spark, sf_dir):
    score = F.col("importance_score")
    docs = fx.analyzed(spark, sf_dir)
    return docs.select("id", routing.route(score, fx.PUSH_MIN, fx.DIGEST_MIN).alias("route"))


@query
def push_batch(spark, sf_dir):
    routed = _card_items(spark, sf_dir).filter(
        routing.route(F.col("importance_score"), fx.PUSH_MIN, fx.DIGEST_MIN) == "push"
    )
    built = messages.push_messages(messages.push_candidates(routed, fx.push_log(spark, sf_dir)))
    log = messages.delivery_events(built, "dry-run", fx.NOW).select("item_id", "recipient", "status")
    carded = built.select(F.col("id").cast("string").alias("item_id"), "card_title", "card_template")
    return carded.join(log, "item_id")


@query
def retry_backoff(spark, sf_dir):
    failures = fx.table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    state = retry.retry_state(failures.select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")), "user_id", "ts", 13)
    return state.select(
        "user_id", "attempts", "status", fx.stamp(F.col("last_failed_at")).alias("last_failed_at"),
        fx.stamp(F.col("next_retry_at")).alias("next_retry_at"),
    )


# ---- constraint checks -----------------------------------------------------------------------


@query
def check_domain(spark, sf_dir):
    return checks.domain_violations(fx.table(spark, sf_dir, "events"), "event_type", ["view", "click", "purchase"])


@query
def check_unique(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(text.sha256_text(text.normalize_text("text")).alias("hash"))
    return checks.unique_violations(docs, ["hash"])


@query
def check_orphans(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels")
    conversations = fx.table(spark, sf_dir, "conversations")
    return checks.orphans(labels, "doc_id", conversations, "conv_id")


@query
def check_not_null(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.nullif("c_acctbal", F.abs("c_acctbal")))
    return checks.null_counts(customers, customers.columns)


# ---- groups and writers over batches -----------------------------------------------------------


@query
def pipeline_groups(spark, sf_dir):
    """Duplicate groups of two consecutive batches over a stored key index: those of one batch."""
    rows = fx.duplicate_rows(spark, sf_dir).withColumnsRenamed({"url": "url_key", "hash": "content_key"})
    rows = rows.withColumns({"at": F.col("created_at"), "own": F.col("id")})
    middle = rows.agg(F.avg(F.col("own"))).scalar()
    index = spark.createDataFrame([], "key string, at timestamp_ntz, group_id bigint")
    first, keys = groups.join_groups(rows.filter(F.col("own") < middle), index, F.col("own"))
    second, _ = groups.join_groups(rows.filter(F.col("own") >= middle), materialize(keys), F.col("own"))
    status = F.when(F.col("is_duplicate"), "ignored").otherwise("new")
    return first.unionByName(second).select("id", "group_id", status.alias("status"))


@query
def settled_writers(spark, sf_dir):
    """Two writers land overlapping thirds of the documents; one settles them, twice. One of each comes out."""
    root = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    entries = fx.feed_entries(spark, sf_dir)
    none = spark.createDataFrame([], "source_url string, reason string, body string")
    for writer, own in (("feeds", F.col("pos") != 0), ("reader", F.col("pos") != 1)):
        pipeline.land_batch(Batch(spark, root, writer, 0), entries.filter(own), none, fx.NOW)
    for _ in range(2):
        pipeline.settle_batch(Batch(spark, root, "settle", 0), fx.NOW, pipeline.Options(push_min=0.0))
    items, raw, analyses, events = (
        read_table(spark, root, t) for t in ("items", "raw_items", "analysis_results", "push_events")
    )
    named = read_table(spark, root, "dedupe_groups").select(
        F.col("id").alias("dedupe_group_id"), F.col("representative_item_id").alias("first_id")
    )

    def number(log, key, name):
        return log.groupBy(F.col(key).alias(f"{name}_key")).agg(F.count("*").alias(name))

    out = items.join(named, "dedupe_group_id")
    out = out.join(items.select(F.col("id").alias("first_id"), F.col("canonical_url").alias("first_url")), "first_id")
    out = out.join(pipeline.item_status(items, analyses, events, pipeline.Options(push_min=0.0)), "id")
    for log, key, name, own in (
        (raw, "url", "n_raw", "canonical_url"),
        (items, "canonical_url", "n_items", "canonical_url"),
        (analyses, "item_id", "n_analyses", "id"),
        (events, "item_id", "n_messages", "id"),
    ):
        out = out.join(number(log, key, name), F.col(own) == F.col(f"{name}_key"), "left").fillna(0, [name])
    return out.select(
        "canonical_url", "first_url", "is_duplicate", "status", "n_raw", "n_items", "n_analyses", "n_messages"
    )


@query
def retry_leases(spark, sf_dir):
    """Users whose items a writer may retry: those that no live lease of a running batch of another holds."""
    events = fx.table(spark, sf_dir, "events")
    writer = F.concat(F.lit("w"), (F.col("event_id") % 4).cast("string"))
    leases = events.select(
        F.col("user_id").alias("item_id"),
        (F.col("ts") + F.make_dt_interval(hours=F.lit(1))).alias("leased_until"),
        writer.alias("writer"),
        F.floor(F.col("event_id") / 1000).alias("batch_id"),
    )
    done = leases.filter("batch_id % 2 = 1").select("writer", "batch_id")
    asked = leases.filter("writer = 'w0' AND batch_id = 0").select("item_id").distinct()
    return retry.grantable(asked, leases, done, "w0", 0, datetime(2024, 1, 29))


@query
def slot_digests(spark, sf_dir):
    """Three slots over the fixture's logs: band, sent check and carry-over; the second one is replayed."""
    root = f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    fx.write_logs(spark, sf_dir, Batch(spark, root, "feeds", 0))
    options = pipeline.Options(push_min=fx.PUSH_MIN, digest_min=fx.DIGEST_MIN, zone="UTC")
    pipeline.digest_due_slots(spark, root, start + timedelta(hours=3), start, [60, 90, 150], 10, options)
    again = Batch(spark, root, "digest", 1)
    at = again.time(start)
    pipeline.digest_batch(again, at, 10, options=options, until=at)
    sent = read_table(spark, root, "push_events").filter("writer = 'digest'")
    return sent.select((F.col("batch_id") + 1).alias("slot"), F.col("item_id").cast("long").alias("id"), "status")


@query
def compacted_logs(spark, sf_dir):
    """Two writers log documents in batches; compaction and clearing between them change no row."""
    root = f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}"
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"), F.col("lang"))
    rows = docs.select(
        "doc_id", F.lit("parse").alias("stage"), F.col("doc_id").cast("string").alias("key"),
        F.col("lang").alias("reason"), F.col("text").alias("detail"), F.lit(fx.NOW).cast("timestamp").alias("created_at"),
    )
    for batch_id in range(5):
        for number, writer in enumerate(("feeds", "reader")):
            batch = Batch(spark, root, writer, batch_id)
            batch.write("rejects", rows.filter((F.col("doc_id") % 2 == number) & (F.col("doc_id") % 5 == batch_id)))
            batch.done(fx.NOW)
        if batch_id > 1:
            at = fx.NOW + timedelta(hours=batch_id)
            compaction.compact(spark, root, "rejects", at, fanout=2)
            compaction.vacuum(spark, root, "rejects", at)
    read = read_table(spark, root, "rejects")
    return read.select(F.col("key").cast("long").alias("doc_id"), "writer", "batch_id", F.length("detail").alias("n_chars"))


@query
def item_language(spark, sf_dir):
    """The language of every document, learned from those whose id is not divisible by five."""
    docs = fx.table(spark, sf_dir, "documents")
    model = language.train_languages(docs.filter(F.col("doc_id") % 5 != 0))
    return language.with_language(docs.select("doc_id", "text"), model, "doc_id").select("doc_id", "language")


@query
def item_novelty(spark, sf_dir):
    """The share of each document's sketch that no smaller id has, over two consecutive batches."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.avg("doc_id")).scalar()
    none = spark.createDataFrame([], "key string")
    first, keys = novelty.novelty(docs.filter(F.col("doc_id") < middle), none, F.col("doc_id"), "doc_id")
    second, _ = novelty.novelty(docs.filter(F.col("doc_id") >= middle), keys, F.col("doc_id"), "doc_id")
    return first.unionByName(second).withColumn("novelty", F.col("novelty").cast("double"))
