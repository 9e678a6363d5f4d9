import json
import os
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from feedloom.operators import checks
from feedloom.operators.language import train_languages
from feedloom.schemas import DOMAINS, FOREIGN_KEYS, TABLES, UNIQUE_KEYS
from feedloom.sources.selection import sample_items
from feedloom.streaming import pipeline
from feedloom.streaming.ingest import ingest_landed, start_feedback, start_ingest
from feedloom.streaming.tables import Batch, read_table

NOW = datetime(2026, 6, 12, tzinfo=timezone.utc)


def feed(title, *entries):
    body = "".join(
        f"<item><title>{t}</title><link>{u}</link><guid>{g}</guid><pubDate>{d}</pubDate>"
        f"<description>{c}</description></item>"
        for g, u, t, c, d in entries
    )
    return f"<rss><channel><title>{title}</title>{body}</channel></rss>"


DAY = "Wed, 10 Jun 2026 12:00:00 GMT"
LONG = "python docker model product " + "word " * 200
A1 = feed(
    "Feed A",
    ("g1", "https://a.org/1?utm_source=x", "Python AI workflow", LONG, DAY),
    ("g2", "https://a.org/2", "Plain", "nothing here", DAY),
    ("g3", "https://a.org/3", "Old", "old", "Wed, 10 Jun 2020 12:00:00 GMT"),
    ("g4", "https://a.org/4", "Undated", "docker note", ""),
)
B1 = feed("Feed B", ("h1", "HTTPS://A.org/1#top", "Copy", "same address", DAY), ("h2", "https://[b/", "Bad", "x", DAY))
A2 = feed(
    "Feed A renamed",
    ("g1", "https://a.org/moved", "Python AI workflow v2", "changed", DAY),
    ("g2", "https://a.org/2", "Plain", "nothing here", DAY),
    ("g9", "https://a.org/2", "Other id, same address", "clash", DAY),
)


def landed(spark, *docs):
    rows = [(u, b, f"{i:03d}") for i, (u, b) in enumerate(docs)]
    return spark.createDataFrame(rows, "source_url string, body string, landed_seq string")


def rows(spark, root, table, *columns):
    return sorted(tuple(r) for r in read_table(spark, root, table).select(*columns).collect())


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "tables")


def run(spark, root, batch_id, docs, now=NOW, **options):
    batch = Batch(spark, root, "feeds", batch_id)
    ingest_landed(batch, landed(spark, *docs), batch.time(now), pipeline.Options(**options))


def test_two_batches(spark, root):
    run(spark, root, 0, [("a", A1), ("b", B1), ("c", "<opml/>")])
    assert rows(spark, root, "items", "canonical_url", "title") == [
        ("https://a.org/1", "Python AI workflow"), ("https://a.org/2", "Plain"), ("https://a.org/4", "Undated"),
    ]
    assert rows(spark, root, "raw_items", "external_id") == [("g1",), ("g2",), ("g4",), ("h1",), ("h2",)]
    assert [r[0] for r in rows(spark, root, "rejects", "reason")] == ["Unsupported feed format", "unreadable address"]
    assert len(rows(spark, root, "dedupe_groups", "id")) == 3
    assert rows(spark, root, "push_events", "recipient", "status", "message_id") == [("dry-run", "sent", "dry-run")]
    (card,) = rows(spark, root, "messages", "card")
    assert json.loads(card[0])["card"]["header"]["title"]["content"] == "Python AI workflow"

    run(spark, root, 1, [("a", A2)], now=NOW + timedelta(hours=4))
    assert len(rows(spark, root, "items", "id")) == 3
    log = read_table(spark, root, "raw_items")
    changed = log.filter("batch_id = 1").select("external_id", "created").collect()
    assert [tuple(r) for r in changed] == [("g1", False)]
    current = {r.external_id: r for r in pipeline.current_raw(log).collect()}
    assert current["g1"].title == "Python AI workflow v2" and current["g1"].url == "https://a.org/1?utm_source=x"
    assert ("address is taken",) in rows(spark, root, "rejects", "reason")
    sources = pipeline.current_sources(read_table(spark, root, "sources"))
    assert {r.url: r.name for r in sources.collect()} == {"a": "Feed A renamed", "b": "Feed B"}
    assert len(rows(spark, root, "push_events", "id")) == 1

    # a replay of the last batch, later on the clock, leaves every log as it was
    before = {t: rows(spark, root, t, *COMPARED[t]) for t in TABLES}
    run(spark, root, 1, [("a", A2)], now=NOW + timedelta(days=3))
    assert before == {t: rows(spark, root, t, *COMPARED[t]) for t in TABLES}


COMPARED = {
    "sources": ["id", "name", "updated_at"], "raw_items": ["id", "title", "content_hash", "created"],
    "items": ["id", "title", "created_at"], "dedupe_groups": ["id"], "analysis_results": ["id", "summary"],
    "messages": ["id", "card"], "push_events": ["id", "status"], "feedback": ["id"], "notes": ["id"],
    "rejects": ["key", "reason", "created_at"], "batch_times": ["batch_at"], "answers": ["id", "message_id"],
    "batch_views": ["seen_writer", "seen_batch"], "batch_done": ["done_at"], "entries": ["external_id", "landed_seq"],
    "group_keys": ["key", "group_id"], "open_items": ["id", "created_at"], "leases": ["item_id", "leased_at"], "granted": ["item_id"],
    "novelty_keys": ["key"],
}


def test_sample_source_is_idempotent(spark, root):
    empty = spark.createDataFrame([], "source_url string, reason string, body string")
    for i in range(2):
        pipeline.ingest_batch(Batch(spark, root, "sample", i), sample_items(spark), empty, NOW)
    assert [len(rows(spark, root, t, "id")) for t in ("items", "analysis_results", "raw_items")] == [1, 1, 1]


def test_failed_delivery_is_logged_retried_and_given_up(spark, root):
    def failing(outbound):
        return outbound.select(
            "id", F.lit(None).cast("string").alias("message_id"), F.lit("timeout").alias("error")
        )

    run(spark, root, 0, [("a", A1)], deliver=failing)
    assert rows(spark, root, "push_events", "status", "last_error") == [("failed", "timeout")]
    options = pipeline.Options(deliver=failing)
    attempts = []
    for i, seconds in enumerate((4, 10, 14, 60, 600)):
        at = NOW + timedelta(seconds=seconds)
        attempts.append(pipeline.retry_batch(Batch(spark, root, "retry", i), at, options).count())
    assert attempts == [0, 1, 0, 1, 0]


def test_digest_feedback_notes_status_and_constraints(spark, root):
    run(spark, root, 0, [("a", A1), ("b", B1)])
    first = pipeline.digest_batch(Batch(spark, root, "digest", 0), NOW, 10)
    assert first.count() == 2
    card = [r.card for r in read_table(spark, root, "messages").filter("writer = 'digest'").collect()]
    elements = json.loads(card[0])["card"]["elements"]
    assert len(elements) == 3 and "2" in elements[0]["text"]["content"]
    assert pipeline.digest_batch(Batch(spark, root, "digest", 1), NOW, 10).count() == 0
    assert pipeline.digest_batch(Batch(spark, root, "digest", 2), NOW, 1, force=True).count() == 1

    items = read_table(spark, root, "items")
    ids = {r.canonical_url: r.id for r in items.collect()}
    payloads = [
        {"action": {"value": {"itemId": ids["https://a.org/2"], "action": "save_obsidian"}}},
        {"item_id": ids["https://a.org/4"], "action": "useful"},
        {"item_id": "nobody", "action": "useful"},
        {"item_id": ids["https://a.org/4"], "action": "dance"},
    ]
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads] + [("{",)], "payload string")
    pipeline.feedback_batch(Batch(spark, root, "feedback", 0), df, NOW)
    assert rows(spark, root, "feedback", "action") == [("save_obsidian",), ("useful",)]
    reasons = read_table(spark, root, "rejects").filter("stage = 'feedback'").select("reason")
    assert sorted(r.reason for r in reasons.collect()) == [
        "invalid feedback action", "payload is not a JSON object", "unknown item",
    ]
    (note,) = pipeline.current_notes(read_table(spark, root, "notes")).collect()
    assert note.path.startswith("notes/2026/06/plain-") and "# Plain\n" in note.markdown

    status = pipeline.item_status(
        items, read_table(spark, root, "analysis_results"), read_table(spark, root, "push_events")
    )
    by_id = {r.id: r.status for r in status.collect()}
    assert {u: by_id[i] for u, i in ids.items()} == {
        "https://a.org/1": "pushed", "https://a.org/2": "ready", "https://a.org/4": "ready",
    }

    table = lambda name: read_table(spark, root, name)
    for (name, column), allowed in DOMAINS.items():
        frame = status if name == "items" else table(name)
        assert checks.domain_violations(frame, column, allowed).isEmpty()
    for name, keys in UNIQUE_KEYS:
        frame = table(name)
        if name == "raw_items":
            frame = pipeline.current_raw(frame)
        elif name == "sources":
            frame = pipeline.current_sources(frame)
        elif name == "notes":
            frame = pipeline.current_notes(frame)
        assert checks.unique_violations(frame, keys).isEmpty(), (name, keys)
    for child, key, parent, parent_key in FOREIGN_KEYS:
        assert checks.orphans(table(child), key, table(parent), parent_key).isEmpty(), (child, key)


def test_stream_equals_batch(spark, root, tmp_path):
    docs = [("https://a.org/feed", A1), ("https://b.org/feed", B1 + " <!-- end -->")]
    landing = tmp_path / "landing"
    for second, (url, body) in enumerate(docs):
        folder = landing / f"source_url={quote(url, safe='')}"
        folder.mkdir(parents=True)
        (folder / "0.xml").write_text(body, encoding="utf-8")
        os.utime(folder / "0.xml", (1_780_000_000 + second,) * 2)
    streamed = str(tmp_path / "streamed")
    # one file per micro-batch against one batch of all files
    q = start_ingest(spark, str(landing), streamed, str(tmp_path / "cp"), clock=lambda: NOW, max_files=1)
    q.awaitTermination()
    run(spark, root, 0, docs)
    for name in ("sources", "raw_items", "items", "analysis_results", "push_events", "rejects"):
        column = "key" if name == "rejects" else "id"
        assert rows(spark, streamed, name, column) == rows(spark, root, name, column)

    (tmp_path / "callbacks").mkdir()
    target = rows(spark, streamed, "items", "id")[0][0]
    (tmp_path / "callbacks" / "0.json").write_text(json.dumps({"item_id": target, "action": "useful"}) + "\n")
    q = start_feedback(spark, str(tmp_path / "callbacks"), streamed, str(tmp_path / "cp2"), clock=lambda: NOW)
    q.awaitTermination()
    assert rows(spark, streamed, "feedback", "item_id") == [(target,)]


class Client:
    """Counts what it is handed; fails on what it is told to."""

    def __init__(self):
        self.calls = []

    def __call__(self, outbound):
        ids = [r.id for r in outbound.select("id").collect()]
        self.calls += ids
        said = [(i, f"m-{i[:6]}", None) for i in ids]
        return outbound.sparkSession.createDataFrame(said, "id string, message_id string, error string")


def test_a_replay_hands_nothing_over_again(spark, root):
    client = Client()
    for _ in range(2):
        run(spark, root, 0, [("a", A1)], deliver=client)
    assert len(client.calls) == 1
    assert len(rows(spark, root, "push_events", "id")) == 1


def test_a_crash_after_the_answers_hands_nothing_over_again(spark, root, monkeypatch):
    client, write = Client(), Batch.write

    def crash(self, table, frame):
        if table == "push_events":
            raise RuntimeError("lost")
        return write(self, table, frame)

    monkeypatch.setattr(Batch, "write", crash)
    with pytest.raises(RuntimeError):
        run(spark, root, 0, [("a", A1)], deliver=client)
    monkeypatch.setattr(Batch, "write", write)
    run(spark, root, 0, [("a", A1)], deliver=client)
    assert len(client.calls) == 1
    assert rows(spark, root, "push_events", "status") == [("sent",)]


def test_a_digest_replay_reads_what_it_read_before(spark, root):
    run(spark, root, 0, [("a", A1)])
    client = Client()
    options = pipeline.Options(deliver=client)
    first = sorted(map(tuple, pipeline.digest_batch(Batch(spark, root, "digest", 0), NOW, 1, options=options).collect()))
    late = feed("Feed C", ("c1", "https://c.org/1", "Newer", "later and plain", "Thu, 11 Jun 2026 12:00:00 GMT"))
    run(spark, root, 1, [("c", late)], now=NOW + timedelta(hours=1))
    again = sorted(map(tuple, pipeline.digest_batch(Batch(spark, root, "digest", 0), NOW, 1, options=options).collect()))
    assert first == again and len(client.calls) == 1
    assert pipeline.digest_batch(Batch(spark, root, "digest", 1), NOW + timedelta(hours=2), 10).count() == 2


def test_two_writers_give_one_item(spark, root, monkeypatch):
    """Another writer's batch runs between the check and the write of this one."""
    write = Batch.write
    state = {"other": False}

    def interleaved(self, table, frame):
        if table == "items" and self.writer == "feeds" and not state["other"]:
            state["other"] = True
            other = Batch(spark, root, "reader", 0)
            docs = landed(spark, ("r", feed("Reader", ("z", "https://a.org/2", "Plain", "nothing here", DAY))))
            ingest_landed(other, docs, other.time(NOW))
        return write(self, table, frame)

    monkeypatch.setattr(Batch, "write", interleaved)
    run(spark, root, 0, [("a", A1)])
    monkeypatch.setattr(Batch, "write", write)
    log = read_table(spark, root, "items")
    assert not checks.unique_violations(log, ["canonical_url"]).isEmpty()
    current = pipeline.current_items(log)
    for _, keys in [k for k in UNIQUE_KEYS if k[0] == "items"]:
        assert checks.unique_violations(current, keys).isEmpty()
    pipeline.digest_batch(Batch(spark, root, "digest", 0), NOW, 10)
    (card,) = [r.card for r in read_table(spark, root, "messages").filter("writer = 'digest'").collect()]
    assert card.count("https://a.org/2") == 1


SAME = feed("Same", ("s1", "https://s.org/1", "Plain", "nothing here", DAY), ("s2", "https://s.org/2", "Python AI workflow", LONG, DAY))


def test_content_duplicates_join_groups_of_earlier_batches(spark, root):
    """A copy under another address is an item of the old group: not analysed, not pushed, ignored."""
    client = Client()
    run(spark, root, 0, [("a", A1)], deliver=client)
    for _ in range(2):  # the second is a replay
        run(spark, root, 1, [("s", SAME)], now=NOW + timedelta(hours=1), deliver=client)
    items = {r.canonical_url: r for r in read_table(spark, root, "items").collect()}
    assert len(items) == 5 and len(rows(spark, root, "dedupe_groups", "id")) == 3
    for copy, first in (("https://s.org/1", "https://a.org/2"), ("https://s.org/2", "https://a.org/1")):
        assert items[copy].dedupe_group_id == items[first].dedupe_group_id
        assert items[copy].is_duplicate and not items[first].is_duplicate
    assert len(rows(spark, root, "analysis_results", "id")) == 3 and len(client.calls) == 1
    logs = [read_table(spark, root, t) for t in ("items", "analysis_results", "push_events")]
    status = {r.id: r.status for r in pipeline.item_status(*logs).collect()}
    assert status[items["https://s.org/2"].id] == "ignored" and status[items["https://a.org/1"].id] == "pushed"
    for child, key, parent, parent_key in FOREIGN_KEYS:
        frames = read_table(spark, root, child), read_table(spark, root, parent)
        assert checks.orphans(frames[0], key, frames[1], parent_key).isEmpty(), (child, key)


def test_pages_of_one_fetch_share_the_limit(spark, root, tmp_path):
    docs = [("a", feed("Feed A", *[(f"p{p}{i}", f"https://a.org/{p}/{i}", "T", f"text {p} {i}", DAY) for i in range(2)])) for p in range(3)]
    run(spark, root, 0, docs, max_items_per_feed=3, pages=True)
    assert rows(spark, root, "raw_items", "external_id") == [("p00",), ("p01",), ("p10",)]
    apart = str(tmp_path / "apart")
    run(spark, apart, 0, docs, max_items_per_feed=1)
    assert rows(spark, apart, "raw_items", "external_id") == [("p00",), ("p10",), ("p20",)]


def land(spark, root, writer, batch_id, docs, now=NOW):
    from feedloom.sources.feeds import parse_feed_rows, split_rows

    found = split_rows(parse_feed_rows(landed(spark, *docs)))
    pipeline.land_batch(Batch(spark, root, writer, batch_id), found.items, found.rejects, now)


def test_two_landing_writers_give_one_of_each(spark, root, monkeypatch):
    """Both bring the same entries at once; one settling writer, with a crash and replays."""
    client, write = Client(), Batch.write
    options = pipeline.Options(deliver=client)
    land(spark, root, "feeds", 0, [("a", A1), ("c", "<opml/>")])
    land(spark, root, "reader", 0, [("a", A1), ("b", B1)])

    def crash(self, table, frame):
        if table == "analysis_results" and self.batch_id == 0:
            # a batch that ends meanwhile is left to the next one
            land(spark, root, "feeds", 1, [("s", SAME)])
            raise RuntimeError("lost")
        return write(self, table, frame)

    monkeypatch.setattr(Batch, "write", crash)
    with pytest.raises(RuntimeError):
        pipeline.settle_pending(spark, root, NOW, options)
    monkeypatch.setattr(Batch, "write", write)
    assert pipeline.settle_pending(spark, root, NOW + timedelta(hours=1), options).batch_id == 0
    assert rows(spark, root, "items", "canonical_url") == [("https://a.org/1",), ("https://a.org/2",), ("https://a.org/4",)]
    before = {t: rows(spark, root, t, *COMPARED[t]) for t in TABLES}
    pipeline.settle_batch(Batch(spark, root, "settle", 0), NOW, options)
    assert before == {t: rows(spark, root, t, *COMPARED[t]) for t in TABLES}
    assert pipeline.settle_pending(spark, root, NOW + timedelta(hours=2), options).batch_id == 1
    land(spark, root, "reader", 1, [("s", SAME), ("a", A1)])
    pipeline.settle_pending(spark, root, NOW + timedelta(hours=3), options)
    pipeline.settle_pending(spark, root, NOW + timedelta(hours=4), options)
    table = lambda name: read_table(spark, root, name)
    for name, keys in UNIQUE_KEYS:
        if name != "sources":
            assert checks.unique_violations(table(name), keys).isEmpty(), (name, keys)
    assert checks.unique_violations(table("analysis_results"), ["item_id"]).isEmpty()
    assert checks.unique_violations(table("push_events"), ["item_id"]).isEmpty()
    assert checks.unique_violations(table("group_keys"), ["key"]).isEmpty()
    assert len(client.calls) == 1 and len(rows(spark, root, "items", "id")) == 5
    assert [r[0] for r in rows(spark, root, "rejects", "reason")] == ["Unsupported feed format", "unreadable address"]


def test_one_of_several_retrying_writers_gets_an_item(spark, root, monkeypatch):
    def failing(outbound):
        return outbound.select("id", F.lit(None).cast("string").alias("message_id"), F.lit("timeout").alias("error"))

    run(spark, root, 0, [("a", A1)], deliver=failing)
    client, write = Client(), Batch.write
    options = pipeline.Options(deliver=client)
    at = NOW + timedelta(seconds=10)

    def interleaved(self, table, frame):
        if table == "granted" and self.writer == "r1":
            # the other one comes in between and steps back, for this one's lease is there
            assert pipeline.retry_batch(Batch(spark, root, "r2", 0), at, options).count() == 0
        return write(self, table, frame)

    monkeypatch.setattr(Batch, "write", interleaved)
    assert pipeline.retry_batch(Batch(spark, root, "r1", 0), at, options).count() == 1
    monkeypatch.setattr(Batch, "write", write)
    assert len(client.calls) == 1
    for writer, batch_id in (("r1", 0), ("r2", 1)):
        pipeline.retry_batch(Batch(spark, root, writer, batch_id), at + timedelta(hours=1), options)
    assert len(client.calls) == 1 and rows(spark, root, "push_events", "status") == [("failed",), ("sent",)]


def test_a_lost_writers_lease_ends(spark, root, monkeypatch):
    def failing(outbound):
        return outbound.select("id", F.lit(None).cast("string").alias("message_id"), F.lit("timeout").alias("error"))

    run(spark, root, 0, [("a", A1)], deliver=failing)
    client, write = Client(), Batch.write
    options = pipeline.Options(deliver=client)

    def crash(self, table, frame):
        if table == "messages" and self.writer == "r1":
            raise RuntimeError("lost")
        return write(self, table, frame)

    monkeypatch.setattr(Batch, "write", crash)
    with pytest.raises(RuntimeError):
        pipeline.retry_batch(Batch(spark, root, "r1", 0), NOW + timedelta(seconds=10), options)
    monkeypatch.setattr(Batch, "write", write)
    assert pipeline.retry_batch(Batch(spark, root, "r2", 0), NOW + timedelta(seconds=20), options).count() == 0
    assert pipeline.retry_batch(Batch(spark, root, "r2", 1), NOW + timedelta(seconds=700), options).count() == 1
    assert pipeline.retry_batch(Batch(spark, root, "r1", 0), NOW + timedelta(seconds=800), options).count() == 0
    assert len(client.calls) == 1


def test_slots_take_turns_and_carry_over(spark, root):
    """Two slots pass at once; each takes one item, newest first, and the rest waits; replays change nothing."""
    late = feed("Late", ("l1", "https://l.org/1", "Later", "plain too", DAY))
    run(spark, root, 0, [("a", A1)])
    run(spark, root, 1, [("l", late)], now=NOW + timedelta(hours=5))
    options = pipeline.Options(zone="UTC")
    day = [60, 120, 360]

    def due(hours):
        return pipeline.digest_due_slots(spark, root, NOW + timedelta(hours=hours), NOW, day, 1, options)

    assert (due(0.5), due(2), due(2), due(6.5)) == (0, 2, 0, 1)
    names = {r.id: r.canonical_url[-3:] for r in read_table(spark, root, "items").collect()}
    sent = read_table(spark, root, "push_events").filter("writer = 'digest'").select("batch_id", "item_id").collect()
    assert sorted(r.batch_id for r in sent) == [0, 1, 2]
    assert {names[r.item_id] for r in sent if r.batch_id < 2} == {"g/2", "g/4"}
    assert {names[r.item_id] for r in sent if r.batch_id == 2} == {"g/1"}
    before = {t: rows(spark, root, t, *COMPARED[t]) for t in TABLES}
    batch = Batch(spark, root, "digest", 1)
    pipeline.digest_batch(batch, batch.time(NOW), 1, options=options, until=batch.time(NOW))
    assert before == {t: rows(spark, root, t, *COMPARED[t]) for t in TABLES}
    state = Batch(spark, root, "digest", 2).own("open_items")
    assert state.isEmpty()


def test_language_and_novelty_of_items(spark, root):
    english = "the cat and the dog went with that to the house of them there "
    german = "der Hund und die Katze gingen mit dem in das Haus von ihnen dort "
    known = spark.createDataFrame([(english, "en"), (german, "de")], "text string, lang string")
    model = train_languages(known, min_texts=1)
    other = "".join(f"u{i} v{i} w{i} " for i in range(80))
    said = english + "".join(f"a{i} b{i} c{i} " for i in range(80))
    first = feed("F", ("1", "https://f.org/1", "Dog", said, DAY), ("2", "https://f.org/2", "Hund", german, DAY), ("3", "https://f.org/3", "12", "34", DAY))
    second = feed("F", ("4", "https://f.org/4", "the dog", said, DAY), ("5", "https://f.org/5", "house of them", other, DAY))
    for _ in range(2):
        run(spark, root, 0, [("f", first)], language_model=model, novelty=True)
    for _ in range(2):
        run(spark, root, 1, [("f", second)], language_model=model, novelty=True)
    items = {r.canonical_url[-1]: r for r in read_table(spark, root, "items").collect()}
    assert {n: r.language for n, r in items.items()} == {"1": "en", "2": "de", "3": None, "4": "en", "5": "en"}
    scores = {r.item_id: float(r.novelty_score) for r in read_table(spark, root, "analysis_results").collect()}
    assert scores[items["1"].id] == 1 and scores[items["4"].id] < 0.05 and scores[items["5"].id] > 0.95
