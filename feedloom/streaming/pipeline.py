"""The curation pipeline as set-at-a-time steps over one batch.

Every step reads earlier rows of the logs, appends its own and hands on what it wrote, so a lost
executor only repeats the step at hand and a replayed batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import slots
from feedloom.functions.cards import digest_card, with_digest_line
from feedloom.functions.scoring import TOPIC_KEYWORDS
from feedloom.functions.text import content_hash, normalize_text, sha256_text
from feedloom.operators import digest, feedback, groups, ingest, latest, messages, notes, novelty, retry, routing, upsert
from feedloom.operators.analyze import analyze_items, normalize_items
from feedloom.operators.language import LanguageModel, with_language
from feedloom.operators.skew import distinct_keys, left_join_unique
from feedloom.schemas import TABLES
from feedloom.session import materialize
from feedloom.streaming.tables import Batch, next_batch

# Gets outbound messages (id, card), returns (id, message_id, error).
Deliver = Callable[[DataFrame], DataFrame]


def dry_run(outbound: DataFrame) -> DataFrame:
    return outbound.select(
        "id",
        F.lit(messages.DRY_RUN).alias("message_id"),
        F.lit(None).cast("string").alias("error"),
    )


@dataclass(frozen=True)
class Options:
    max_items_per_feed: int = ingest.MAX_ITEMS_PER_FEED
    max_age_days: int = ingest.MAX_AGE_DAYS
    push_min: float = routing.PUSH_MIN
    digest_min: float = routing.DIGEST_MIN
    recipient: str = messages.DRY_RUN
    zone: str = slots.DEFAULT_ZONE
    notes_root: str = notes.DEFAULT_ROOT
    lexicon: dict[str, list[str]] = field(default_factory=lambda: TOPIC_KEYWORDS)
    deliver: Deliver = dry_run
    # the documents of a feed in one batch are pages of one fetch
    pages: bool = False
    # fills the language of items
    language_model: LanguageModel | None = None
    # novelty from the words of earlier items, in place of the analyzer's constants
    novelty: bool = False


def _key(*columns: str) -> Column:
    return sha256_text(F.concat_ws("\n", *columns))


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def _rejects(rows: DataFrame, stage: str, key: str, reason: Column, detail: str, now: datetime) -> DataFrame:
    return rows.select(
        F.lit(stage).alias("stage"),
        F.col(key).alias("key"),
        reason.alias("reason"),
        F.col(detail).alias("detail"),
        _at(now).alias("created_at"),
    )


# ---- ingest ----------------------------------------------------------------------------------


def upsert_sources(batch: Batch, items: DataFrame, now: datetime) -> DataFrame:
    """Log sources that are new or renamed; the last name in the batch wins."""
    named = latest.latest_per_key(
        items.select("source_url", "source_name", "landed_seq", "pos"),
        ["source_url"],
        [F.col("landed_seq").desc(), F.col("pos").desc()],
    ).select(F.col("source_url").alias("url"), F.col("source_name").alias("name"))
    known = current_sources(batch.prior("sources")).select("url", F.col("name").alias("__name"))
    changed = named.join(known, "url", "left").filter(~F.col("name").eqNullSafe(F.col("__name")))
    rows = changed.select(
        sha256_text("url").alias("id"),
        F.lit("rss").alias("type"),
        "name",
        "url",
        F.lit(True).alias("enabled"),
        _at(now).alias("updated_at"),
    )
    return batch.write("sources", rows)


def current_sources(log: DataFrame) -> DataFrame:
    return latest.latest_per_key(log, ["url"], newest_first("updated_at"))


def newest_first(at: str) -> list[Column]:
    """A total order over the rows of all writers: batch ids compare within a writer only."""
    return [F.col(at).desc(), F.col("writer").desc(), F.col("batch_id").desc()]


def current_items(log: DataFrame) -> DataFrame:
    """One row per item: where two writers brought the same address, the first counts."""
    return latest.latest_per_key(log, ["id"], [F.col("created_at"), F.col("writer"), F.col("batch_id")])


def entry_texts(items: DataFrame) -> DataFrame:
    """Entries with the id of their raw item and a key of their place in it."""
    return items.select(
        sha256_text("source_url").alias("source_id"),
        "external_id", "url", "author", "published_at", "title",
        F.col("content").alias("raw_content"), "raw_payload", "landed_seq", "pos",
    ).withColumns(
        {
            "id": _key("source_id", "external_id"),
            # nulls are left out of the JSON, so they differ from any value
            "version": F.unhex(sha256_text(F.to_json(F.struct("source_id", "external_id", "landed_seq", "pos")))),
        }
    )


def merge_batch_versions(texts: DataFrame) -> DataFrame:
    """One row per (source, external id): address, author and date of the first version, hash and place of the last.

    Texts stay where they are; ``last_texts`` takes those of the last versions.
    """
    keyed = texts.select(
        "id", "source_id", "external_id", "url", "author", "published_at", "landed_seq", "pos", "version",
        content_hash("title", "url", "raw_content").alias("content_hash"),
    )
    return upsert.merge_first_last(
        keyed,
        ["id", "source_id", "external_id"],
        ["landed_seq", "pos", "content_hash"],
        ["url", "author", "published_at", "landed_seq", "pos"],
        ["version", "content_hash"],
    )


def last_texts(merged: DataFrame, texts: DataFrame) -> DataFrame:
    """Merged rows with title, text and payload of their last version; each text moves once.

    Versions that are equal in order and hash have equal texts; one of them is taken.
    """
    text = ["title", "raw_content", "raw_payload"]
    versions = texts.select(F.col("version").alias("__version"), F.col("url").alias("__url"), *text)
    found = merged.join(versions, F.col("version") == F.col("__version")).filter(
        F.col("content_hash") == content_hash("title", "__url", "raw_content")
    )
    # the keys of the join, so that nothing moves again
    one = latest.latest_per_key(found, ["version", "content_hash"], [F.col("content_hash")])
    return one.select(*merged.columns, *text)


def raw_verdicts(batch: Batch, merged: DataFrame) -> DataFrame:
    """(id, url, created, changed, conflict) per raw item of the batch, from narrow columns."""
    keys = merged.select("id", "source_id", "url", "content_hash", "landed_seq", "pos")
    prior = batch.prior("raw_items")
    hits = prior.select("id", F.col("content_hash").alias("__hash"), "created_at", "writer", "batch_id").join(
        distinct_keys(keys, "id"), "id", "left_semi"
    )
    newest = latest.latest_per_key(hits, ["id"], newest_first("created_at")).select("id", "__hash")
    compared = keys.join(newest, "id", "left").withColumns(
        {
            "created": F.col("__hash").isNull(),
            "changed": F.coalesce(F.col("__hash") != F.col("content_hash"), F.lit(False)),
        }
    )
    # An address belongs to the first external id that brought it, earlier or in this batch.
    address = ["source_id", "url"]
    taken = upsert.seen_keys(prior.filter("created").select(*address), keys, address)
    place = F.to_json(F.struct(*address))
    taken = taken.select(place.alias("__taken_place"), F.lit(True).alias("__taken"))
    checked = left_join_unique(compared.withColumn("__place", place), taken, "__place", "__taken_place")
    # read three times below
    checked = materialize(checked.drop("__place", "__hash", "content_hash"))
    flagged = upsert.flag_key_conflicts(
        checked.filter("created"), address, "id", ["landed_seq", "pos"]
    )
    conflict = F.coalesce("__taken", F.lit(False)) | F.col("conflict")
    known = checked.filter("not created").withColumn("conflict", F.lit(False))
    return flagged.withColumn("conflict", conflict).unionByName(known).select(
        "id", "url", "created", "changed", "conflict"
    )


def upsert_raw(batch: Batch, items: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Log raw items that are new or changed; returns (logged rows, rows with a taken address)."""
    texts = entry_texts(items)
    merged = materialize(merge_batch_versions(texts))
    verdicts = materialize(raw_verdicts(batch, merged))
    wanted = verdicts.filter("not conflict and (created or changed)").select("id", "created")
    rows = last_texts(merged.join(wanted, "id"), texts)
    logged = batch.write("raw_items", rows.withColumn("created_at", _at(now)))
    return logged, verdicts.filter("conflict")


def group_raw(batch: Batch, readable: DataFrame, now: datetime) -> DataFrame:
    """(id, group_id, is_duplicate) of new raw items by address or content; logs the keys they bring.

    A content is a title with a text; raw items without a text share no content.
    """
    place = ["created_at", "landed_seq", "source_id", "pos"]
    rows = readable.withColumn("created_at", _at(now)).select(
        "id",
        F.struct(*place, "id").alias("at"),
        F.concat(F.lit("url:"), sha256_text("canonical_url")).alias("url_key"),
        "content_key",
    )
    index = batch.prior("group_keys").select("key", "group_id", F.struct(*place, F.col("raw_item_id").alias("id")).alias("at"))
    grouped, added = groups.join_groups(rows, index, _key("id"))
    log = added.select("key", "group_id", F.col("id").alias("raw_item_id"), *[F.col(f"at.{c}") for c in place])
    batch.write("group_keys", log)
    return grouped


def insert_items(
    batch: Batch, raw: DataFrame, now: datetime, options: Options = Options()
) -> tuple[DataFrame, DataFrame]:
    """Log one item per canonical address not seen before; returns (items, unreadable addresses).

    An item whose content is that of an earlier raw item belongs to its group, as a duplicate.
    """
    created = raw.filter("created")
    content = F.when(F.col("content") != "", F.concat(F.lit("content:"), _key("title", "content")))
    unreadable = F.col("canonical_url").isNull()
    # all is decided without the texts, which meet their item in one join
    normal = materialize(
        normalize_items(created).select(
            "id", "canonical_url", "normalized_hash", content.alias("content_key"), "landed_seq", "source_id", "pos",
            F.when(unreadable, F.col("url")).alias("url"),
        )
    )
    readable = normal.filter(~unreadable)
    grouped = group_raw(batch, readable, now).withColumnRenamed("id", "__raw")
    order = [F.col("landed_seq"), F.col("source_id"), F.col("pos"), F.col("id")]
    narrow = readable.select("id", "canonical_url", "normalized_hash", "landed_seq", "source_id", "pos")
    first = upsert.insert_if_absent(narrow, batch.prior("items"), ["canonical_url"], order)
    joined = first.withColumnRenamed("id", "raw_item_id").join(grouped, F.col("raw_item_id") == F.col("__raw"))
    texts = created.select(F.col("id").alias("__text_of"), "title", normalize_text("raw_content").alias("content"))
    rows = joined.join(texts, F.col("raw_item_id") == F.col("__text_of")).withColumns(
        {
            "id": sha256_text("canonical_url"),
            "language": F.lit(None).cast("string"),
            "created_at": _at(now),
        }
    )
    rows = rows.withColumnRenamed("group_id", "dedupe_group_id")
    if options.language_model is not None:
        rows = materialize(rows.withColumn("__words", F.concat_ws(" ", "title", "content")))
        rows = with_language(rows, options.language_model, "id", "__words")
    return batch.write("items", rows), normal.filter(unreadable)


def open_groups(batch: Batch, items: DataFrame, now: datetime) -> DataFrame:
    """Log one group per item that joins none; its items are found by their ``dedupe_group_id``."""
    rows = items.filter("not is_duplicate").select(
        F.col("dedupe_group_id").alias("id"),
        F.col("id").alias("representative_item_id"),
        F.lit("canonical_url").alias("reason"),
        _at(now).alias("created_at"),
    )
    return batch.write("dedupe_groups", rows)


def analyze_new(batch: Batch, items: DataFrame, now: datetime, options: Options) -> DataFrame:
    """Log one analysis per item that has none; duplicates get none."""
    items = items.filter("not is_duplicate")
    done = batch.prior("analysis_results").select(F.col("item_id").alias("id"))
    texts = items.select("id", "title", "content")
    # scored where the texts are; only what comes of them meets the log
    scored = analyze_items(texts, options.lexicon, content_normalized=True).drop("title", "content")
    scored = scored.join(upsert.seen_keys(done, items, ["id"]), "id", "left_anti")
    if options.novelty:
        scored = _with_novelty(batch, items, scored)
    rows = scored.withColumnRenamed("id", "item_id").withColumns(
        {
            "id": _key("item_id", "model_name"),
            "importance_score": F.col("importance_score").cast("decimal(4,3)"),
            "novelty_score": F.col("novelty_score").cast("decimal(4,3)"),
            "created_at": _at(now),
        }
    )
    return batch.write("analysis_results", rows)


def _with_novelty(batch: Batch, items: DataFrame, scored: DataFrame) -> DataFrame:
    """The share of an item's words that no earlier item has; texts without a sketch keep their score.

    All items of the batch that are no duplicates bring their keys, analyzed before or not, so that a
    replay finds the same.
    """
    texts = items.select("id", F.concat_ws(" ", "title", "content").alias("text"))
    found, keys = novelty.novelty(texts, batch.prior("novelty_keys"), F.lit(0), "id")
    batch.write("novelty_keys", keys)
    said = found.select(F.col("id").alias("__said"), "novelty")
    joined = left_join_unique(scored, materialize(said), "id", "__said")
    score = F.coalesce(F.col("novelty").cast("double"), F.col("novelty_score"))
    return joined.withColumn("novelty_score", score).drop("novelty")


def ingest_batch(
    batch: Batch, items: DataFrame, rejects: DataFrame, now: datetime, options: Options = Options()
) -> None:
    """Feed items to logs: guard, upsert, normalize, group, analyze, push.

    For one writer. Where several bring feed items, they ``land_batch`` and one writer settles.
    """
    _settle(batch, ingest.age_guard(items, now, options.max_age_days), rejects, now, options)


def land_batch(
    batch: Batch, items: DataFrame, rejects: DataFrame, now: datetime, options: Options = Options()
) -> None:
    """Log the recent feed items of one of several writers; ``settle_batch`` takes them from there."""
    batch.write("entries", ingest.age_guard(items, now, options.max_age_days))
    batch.write("rejects", _rejects(rejects, "parse", "source_url", F.col("reason"), "body", now))
    batch.done(now)


def settle_batch(batch: Batch, now: datetime, options: Options = Options()) -> None:
    """What other writers have landed since the batch before, to raw items, items, analyses and messages.

    Run by one writer, so that each address, item, analysis and message has one owner however the
    landing writers interleave: of what they bring at the same time, the first by batch order counts.
    Batches that were not done are left to the next one. Only the folders of new batches are read.
    """
    entries = batch.new("entries")
    place = F.format_string("%s/%012d/%s", "writer", "batch_id", F.coalesce("landed_seq", F.lit("")))
    entries = entries.withColumn("landed_seq", place).drop("writer", "batch_id")
    nothing = batch.spark.createDataFrame([], "source_url string, reason string, body string")
    _settle(batch, entries, nothing, now, options)


def settle_pending(
    spark: SparkSession, root: str, now: datetime, options: Options = Options(), writer: str = "settle"
) -> Batch:
    """Run the next batch of the settling writer, or the one that did not come to its end."""
    batch = next_batch(spark, root, writer)
    settle_batch(batch, batch.time(now), options)
    return batch


def _settle(batch: Batch, recent: DataFrame, rejects: DataFrame, now: datetime, options: Options) -> None:
    upsert_sources(batch, recent, now)
    raw, taken = upsert_raw(batch, recent, now)
    new_items, unreadable = insert_items(batch, raw, now, options)
    open_groups(batch, new_items, now)
    analyses = analyze_new(batch, new_items, now, options)
    push_batch(batch, analyses, now, options)
    refused = (
        _rejects(rejects, "parse", "source_url", F.col("reason"), "body", now)
        .unionByName(_rejects(taken, "raw", "id", F.lit("address is taken"), "url", now))
        .unionByName(_rejects(unreadable, "normalize", "id", F.lit("unreadable address"), "url", now))
    )
    batch.write("rejects", refused)
    batch.done(now)


# ---- push and digest ---------------------------------------------------------------------------


def described_items(batch: Batch, ids: DataFrame) -> DataFrame:
    """Items of a key set with source name, publish time and latest analysis."""
    log = materialize(
        current_items(batch.all("items").join(ids, "id", "left_semi")).select(
            "id", "raw_item_id", "canonical_url", "title", "created_at"
        )
    )
    # the history is cut to the batch's keys before it is joined
    raw = batch.all("raw_items").filter("created").select(
        F.col("id").alias("raw_item_id"), "source_id", "published_at"
    )
    raw = materialize(raw.join(distinct_keys(log, "raw_item_id"), "raw_item_id", "left_semi"))
    named_sources = batch.all("sources").withColumn("source_id", F.col("id"))
    named_sources = named_sources.join(distinct_keys(raw, "source_id"), "source_id", "left_semi")
    sources = current_sources(named_sources).select(
        F.col("id").alias("__source_id"), F.col("name").alias("source_name")
    )
    analyses = batch.all("analysis_results").withColumnRenamed("id", "analysis_id")
    analyses = analyses.withColumnRenamed("item_id", "id").withColumnRenamed("created_at", "analyzed_at")
    joined = log.join(raw, "raw_item_id")
    named = left_join_unique(joined, sources, "source_id", "__source_id")
    return latest.left_join_latest(
        named,
        analyses.join(ids, "id", "left_semi"),
        "id",
        [F.col("analyzed_at").desc(), F.col("analysis_id").desc()],
        ["summary", "reason", "importance_score"],
    )


def retry_due(batch: Batch, now: datetime, recipient: str) -> DataFrame:
    """Items whose failed pushes are due again and not yet dead."""
    failed = batch.prior("push_events").filter(
        (F.col("status") == "failed") & (F.col("recipient") == recipient)
    )
    state = retry.retry_state(failed, "item_id", "created_at")
    due = state.filter((F.col("status") == "pending") & (F.col("next_retry_at") <= _at(now)))
    return due.select(F.col("item_id").alias("id"))


def push_batch(
    batch: Batch, analyses: DataFrame, now: datetime, options: Options = Options(), force: bool = False
) -> DataFrame:
    """Card, hand over and log every item routed to an immediate push that was never sent."""
    routed = analyses.filter(
        routing.route(F.col("importance_score"), options.push_min, options.digest_min) == "push"
    ).select(F.col("item_id").alias("id"))
    return _push(batch, routed.distinct(), now, options, force)


def _push(batch: Batch, wanted: DataFrame, now: datetime, options: Options, force: bool = False) -> DataFrame:
    unsent = materialize(messages.push_candidates(wanted, batch.prior("push_events"), force))
    carded = messages.push_messages(described_items(batch, unsent))
    return _deliver(batch, carded.select("id", "card"), options.recipient, now, options)


def retry_batch(
    batch: Batch, now: datetime, options: Options = Options(), lease_seconds: int = retry.LEASE_SECONDS
) -> DataFrame:
    """Hand over failed pushes that are due again; the only step that does, by any number of writers.

    A writer logs leases on the items it wants before it looks at those of others, and keeps the items
    that no other running batch holds. A lease ends with its batch or after ``lease_seconds``, so what a
    lost writer held comes to another one; a replay then leaves that out.
    """
    granted = batch.own("granted")
    if granted is None:
        due = retry_due(batch, now, options.recipient).select(F.col("id").alias("item_id"))
        until = _at(now + timedelta(seconds=lease_seconds))
        asked = batch.write("leases", due.withColumns({"leased_at": _at(now), "leased_until": until}))
        free = retry.grantable(
            asked, batch.current("leases"), batch.current("batch_done"), batch.writer, batch.batch_id, now
        )
        granted = batch.write("granted", free)
    others = batch.current("granted").filter(F.col("writer") != batch.writer)
    taken = others.select("item_id", F.col("leased_at").alias("__later"))
    lost = granted.join(taken, "item_id").filter(F.col("__later") >= F.col("leased_at")).select("item_id").distinct()
    mine = granted.join(lost, "item_id", "left_anti")
    events = _push(batch, mine.select(F.col("item_id").alias("id")), now, options)
    batch.done(now)
    return events


def _answers(batch: Batch, outbound: DataFrame, deliver: Deliver) -> DataFrame:
    """What the client says to each message, one row per message.

    Messages that an earlier run of the batch has handed over are not handed over again. The answers
    are written before anything is logged; between the client and that lies only this write, for
    which clients should take the id of a message twice as one message.
    """
    before = batch.own("answers")
    if before is None:
        waiting = outbound
        kept = None
    else:
        kept = materialize(before.filter(F.col("error").isNull()))
        waiting = outbound.join(kept, "id", "left_anti")
    said = deliver(waiting).groupBy("id").agg(F.max("message_id").alias("message_id"), F.max("error").alias("error"))
    fresh = said.join(waiting.select("id"), "id", "left_semi")
    return batch.write("answers", fresh if kept is None else kept.unionByName(fresh))


def _deliver(batch: Batch, carded: DataFrame, recipient: str, now: datetime, options: Options) -> DataFrame:
    outbound = batch.write(
        "messages",
        carded.withColumns({"recipient": F.lit(recipient), "created_at": _at(now)}),
    )
    answered = _answers(batch, outbound.select("id", "card"), options.deliver)
    log = messages.delivery_events(answered, recipient, now, F.col("message_id"), F.col("error"))
    return batch.write("push_events", log)


def waiting_items(batch: Batch, options: Options) -> DataFrame:
    """What waits for this digest, from what the one before left and what came since.

    Without a state of the digest before, as for the first one, the whole logs are read.
    """
    state = Batch(batch.spark, batch.root, batch.writer, batch.batch_id - 1).own("open_items")
    read = batch.prior if state is None else batch.new
    if state is None:
        state = batch.spark.createDataFrame([], TABLES["open_items"])
    found = digest.open_items(
        state, current_items(read("items")), read("analysis_results"), read("push_events"),
        options.recipient, options.push_min, options.digest_min,
    )
    return materialize(found)


def every_item(batch: Batch, options: Options) -> DataFrame:
    """What a forced digest chooses from: items in the band, sent in a digest before or not."""
    items = current_items(batch.prior("items")).select("id", "created_at")
    events = batch.prior("push_events")
    ready = routing.not_yet_sent(items, events, options.recipient).withColumn("status", F.lit("ready"))
    return digest.digest_candidates(
        ready, batch.prior("analysis_results"), events, options.recipient, True, options.push_min, options.digest_min
    )


def digest_batch(
    batch: Batch,
    now: datetime,
    limit: int | str | None = 10,
    force: bool = False,
    options: Options = Options(),
    until: datetime | None = None,
) -> DataFrame:
    """Select, card and log one digest; returns the logged events (none when nothing waits).

    Items that came after ``until``, that are beyond the limit or whose message failed wait on: they
    are logged as the state that the next digest starts from.
    """
    waiting = waiting_items(batch, options)
    pool = every_item(batch, options) if force else waiting
    if until is not None:
        pool = pool.filter(F.col("created_at") <= _at(until))
    chosen = materialize(digest.select_digest(pool.select("id", "created_at"), limit))
    logged = _digest(batch, chosen, now, options)
    batch.write("open_items", routing.not_yet_sent(waiting, logged))
    batch.done(now)
    return logged


def digest_due_slots(
    spark: SparkSession,
    root: str,
    now: datetime,
    start: datetime,
    minutes: list[int],
    limit: int | str | None = 10,
    options: Options = Options(),
    writer: str = "digest",
) -> int:
    """One digest for each slot of the local day up to ``now`` that had none; returns their number.

    The first slot is the one after ``start``, later calls go on after the last digest. What a slot
    does not take is carried over to the next. A slot whose run was lost is run again, with its time.
    """
    ran = 0
    while True:
        batch = next_batch(spark, root, writer)
        before = batch.last_time(now)
        slot = slots.slot_after(before or start, minutes, options.zone)
        if slot > now:
            return ran
        at = batch.time(slot)
        digest_batch(batch, at, limit, options=options, until=at)
        ran += 1


def _digest(batch: Batch, chosen: DataFrame, now: datetime, options: Options) -> DataFrame:
    recipient = digest.digest_recipient(options.recipient)
    lines = with_digest_line(digest.number_lines(described_items(batch, chosen.select("id"))))
    members = lines.select("id", "idx", "line")
    card = digest_card(members).select(sha256_text("card").alias("id"), "card")
    outbound = batch.write(
        "messages", card.withColumns({"recipient": F.lit(recipient), "created_at": _at(now)})
    )
    # one card, so one answer, which holds for each of its items
    answer = _answers(batch, outbound.select("id", "card"), options.deliver)
    answered = chosen.select("id").withColumn("__one", F.lit(1)).join(
        answer.select("message_id", "error", F.lit(1).alias("__one")), "__one"
    )
    said = F.col("message_id")
    message_id = F.when(said == messages.DRY_RUN, F.lit(messages.DIGEST_DRY_RUN)).otherwise(said)
    log = messages.delivery_events(answered, recipient, now, message_id, F.col("error"))
    return batch.write("push_events", log)


# ---- feedback and notes --------------------------------------------------------------------------


def feedback_batch(batch: Batch, payloads: DataFrame, now: datetime, options: Options = Options()) -> None:
    """Validate callbacks (column payload), log them and write the notes they ask for."""
    checked = feedback.feedback_fields(payloads.select("payload"))
    known = batch.prior("items").select(F.col("id").alias("item_id"))
    seen = upsert.seen_keys(known, checked.filter("problem is null"), ["item_id"]).withColumn(
        "__known", F.lit(True)
    )
    seen = seen.withColumnRenamed("item_id", "__item_id")
    marked = left_join_unique(checked, seen, "item_id", "__item_id").withColumn(
        "problem",
        F.coalesce(F.col("problem"), F.when(F.col("__known").isNull(), F.lit("unknown item"))),
    )
    logged = batch.write("feedback", feedback.feedback_log(marked, now))
    refused = _rejects(
        marked.filter(F.col("problem").isNotNull()), "feedback", "item_id", F.col("problem"), "payload", now
    )
    batch.write("rejects", refused)
    note_batch(batch, feedback.note_requests(logged).select(F.col("item_id").alias("id")), now, options)
    batch.done(now)


def note_batch(batch: Batch, ids: DataFrame, now: datetime, options: Options = Options()) -> DataFrame:
    """Build and log the notes of the given items; the newest row per item counts."""
    built = notes.build_notes(described_items(batch, ids), now, options.notes_root, options.zone)
    return batch.write("notes", notes.note_log(built, now))


# ---- views -----------------------------------------------------------------------------------


def current_raw(log: DataFrame) -> DataFrame:
    """Raw items as an upsert would leave them."""
    return upsert.merge_first_last(
        log,
        ["id"],
        ["created_at", "writer", "batch_id"],
        ["source_id", "external_id", "url", "author", "published_at"],
        ["title", "raw_content", "raw_payload", "content_hash"],
    )


def current_notes(log: DataFrame) -> DataFrame:
    return latest.latest_per_key(log, ["item_id"], newest_first("updated_at"))


def item_status(
    items: DataFrame, analyses: DataFrame, push_events: DataFrame, options: Options = Options()
) -> DataFrame:
    """(id, status) of all items from the logs."""
    newest = latest.latest_per_key(analyses, ["item_id"], [F.col("created_at").desc(), F.col("id").desc()])
    plain = items.select("id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))
    derived = routing.with_status(
        plain, newest, push_events, options.recipient, options.push_min, options.digest_min
    )
    return derived.drop("is_duplicate")
