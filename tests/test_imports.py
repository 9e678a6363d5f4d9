"""Imported rows against the constraints of the pipeline's own logs."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedloom.operators import checks
from feedloom.schemas import TABLES
from feedloom.streaming.imports import import_rows
from feedloom.streaming.tables import Batch, read_table

NOW = datetime(2026, 6, 10, tzinfo=timezone.utc)


def frame(spark, table, rows):
    kinds = spark.createDataFrame([], TABLES[table]).dtypes
    values = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in rows[0]) if rows else "id string")
    columns = [(F.col(c) if c in values.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds]
    return values.select(*columns)


def test_rows_that_break_a_constraint_stay_out(spark, tmp_path):
    root = str(tmp_path / "tables")
    at = "2026-06-01 00:00:00"

    def item(i, raw, url):
        return {"id": i, "raw_item_id": raw, "canonical_url": url, "created_at": at}

    raws = [{"id": f"r{i}", "url": f"u{i}", "created_at": at} for i in range(6)]
    import_rows(Batch(spark, root, "backfill", 0), "raw_items", frame(spark, "raw_items", raws), NOW)
    first = [item("i0", "r0", "u0"), item("i1", "r1", "u1"), item("i2", "nowhere", "u2")]
    import_rows(Batch(spark, root, "backfill", 1), "items", frame(spark, "items", first), NOW)
    again = [
        item("i1", "r3", "u3"), item("i3", "r0", "u4"), item("i4", "r4", "u1"), item("i5", "r5", "u5"),
        item("i6", "r5", "u6"), item(None, "r2", "u7"), item("i2", "r2", "u2"),
    ]
    for _ in range(2):  # and its replay
        import_rows(Batch(spark, root, "backfill", 2), "items", frame(spark, "items", again), NOW)
        items = read_table(spark, root, "items")
        assert sorted(r.id for r in items.collect()) == ["i0", "i1", "i2", "i5"]
        refused = read_table(spark, root, "rejects").filter("stage = 'import items'")
        assert sorted((str(r.key), r.reason) for r in refused.collect()) == [
            ("None", "null:id"), ("i1", "unique:id"), ("i2", "orphan:raw_item_id"), ("i3", "unique:raw_item_id"),
            ("i4", "unique:canonical_url"), ("i6", "unique:raw_item_id"),
        ]
    events = [
        {"id": "e0", "item_id": "i0", "status": "sent", "created_at": at},
        {"id": "e1", "item_id": "i9", "status": "lost", "created_at": at},
    ]
    logged = import_rows(Batch(spark, root, "events", 0), "push_events", frame(spark, "push_events", events), NOW)
    assert [r.id for r in logged.collect()] == ["e0"]
    (out,) = read_table(spark, root, "rejects").filter("stage = 'import push_events'").collect()
    assert out.reason == "domain:status,orphan:item_id"
    for key in (["id"], ["raw_item_id"], ["canonical_url"]):
        assert checks.unique_violations(items, key).isEmpty()
