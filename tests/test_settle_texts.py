"""What settles a batch decides on narrow rows; texts are written to the logs alone."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedloom.schemas import FEED_ITEM
from feedloom.streaming import pipeline
from feedloom.streaming.tables import Batch, read_table

NOW = datetime(2026, 6, 12, tzinfo=timezone.utc)


def entry(external_id, url, title, content, seq, pos=0, author=None, source="https://s.org"):
    return ("S", source, external_id, url, title, author, None, content, {"t": title}, pos, seq)


def settle(spark, root, rows, batch_id=0):
    none = spark.createDataFrame([], "source_url string, reason string, body string")
    entries = spark.createDataFrame(rows, FEED_ITEM)
    pipeline.ingest_batch(Batch(spark, root, "feeds", batch_id), entries, none, NOW, pipeline.Options(push_min=0.0))


def test_no_text_is_written_between_the_logs(spark, tmp_path, monkeypatch):
    kept, held = pipeline.materialize, []

    def watched(frame):
        held.append(set(frame.columns))
        return kept(frame)

    monkeypatch.setattr(pipeline, "materialize", watched)
    settle(spark, str(tmp_path), [entry("a", "https://s.org/a", "T", "text", "1")])
    assert held and not [c for c in held if c & {"raw_content", "content", "raw_payload"}]
    assert read_table(spark, str(tmp_path), "items").select("content").collect() == [("text",)]


def test_versions_of_one_batch_give_the_first_address_and_the_last_text(spark, tmp_path):
    root = str(tmp_path)
    first = entry("a", "https://s.org/a", "Old", "old text", "1", 3, "Ann")
    last = entry("a", "https://s.org/a2", "New", "new  text", "2", 0, "Bob")
    place = [entry("b", "https://s.org/b", "B", t, "1", 1) for t in ("one", "two")]
    nulls = [entry("c", "https://s.org/c", None, None, None, None), entry("c", "https://s.org/c", "C", "later", "0", 0)]
    copies = [entry("d", "https://s.org/d", "D", "copy", "1", 2)] * 3
    settle(spark, root, [last, first, *place, *nulls, *copies])
    raw = {r.external_id: r for r in read_table(spark, root, "raw_items").collect()}
    assert sorted(raw) == ["a", "b", "c", "d"] and read_table(spark, root, "raw_items").count() == 4
    a = raw["a"]
    assert (a.url, a.author, a.pos, a.landed_seq) == ("https://s.org/a", "Ann", 3, "1")
    assert (a.title, a.raw_content, a.raw_payload) == ("New", "new  text", {"t": "New"})
    # of two texts at one place, the one whose hash is stored
    b = spark.createDataFrame([("B", "https://s.org/b", t) for t in ("one", "two")], "t string, u string, c string")
    hashed = {r.h: r.c for r in b.select("c", pipeline.content_hash("t", "u", "c").alias("h")).collect()}
    assert raw["b"].raw_content == hashed[raw["b"].content_hash] and raw["b"].content_hash == max(hashed)
    assert (raw["c"].title, raw["c"].raw_content) == ("C", "later")
    items = {r.raw_item_id: r for r in read_table(spark, root, "items").collect()}
    assert items[a.id].canonical_url == "https://s.org/a" and items[a.id].content == "new text" and len(items) == 4
    done = read_table(spark, root, "analysis_results").select(F.col("item_id"))
    assert sorted(r.item_id for r in done.collect()) == sorted(r.id for r in items.values())


def test_an_entry_without_source_and_place_is_kept(spark, tmp_path):
    root = str(tmp_path)
    settle(spark, root, [entry("n", "https://s.org/n", "N", "null place", None, None, source=None)])
    assert [(r.external_id, r.raw_content) for r in read_table(spark, root, "raw_items").collect()] == [("n", "null place")]


def test_the_texts_of_the_last_versions_move_once(spark):
    """One exchange for the texts, one for the merged rows, none between their join and the choice of one copy."""
    texts = pipeline.entry_texts(spark.createDataFrame([entry("a", "https://s.org/a", "T", "text", "1")], FEED_ITEM))
    merged = pipeline.merge_batch_versions(texts).localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pipeline.last_texts(merged, texts)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 2, plan
