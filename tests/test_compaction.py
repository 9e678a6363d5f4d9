from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.streaming import pipeline
from feedloom.streaming.compaction import all_generations, compact, small_batches, vacuum
from feedloom.streaming.tables import Batch, read_table

NOW = datetime(2026, 6, 12, tzinfo=timezone.utc)


def write(spark, root, writer, batch_id, n=3):
    batch = Batch(spark, root, writer, batch_id)
    rows = spark.range(n).select(
        F.lit("s").alias("stage"), F.format_string(f"{writer}-{batch_id}-%d", "id").alias("key"), F.lit("r").alias("reason"),
        F.lit(None).cast("string").alias("detail"), F.lit(NOW).cast("timestamp").alias("created_at"),
    )
    batch.write("rejects", rows)
    batch.done(NOW)


def content(spark, root):
    return sorted(map(tuple, read_table(spark, root, "rejects").select("writer", "batch_id", "key").collect()))


def files(root, table="rejects"):
    return len(list(Path(root).glob(f"{table}/**/*.parquet"))) + len(list(Path(root).glob(f"segments/log={table}/**/*.parquet")))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def test_rows_stay_while_files_become_few(spark, root):
    assert compact(spark, root, "rejects", NOW) is None
    expected = []
    for n in range(7):
        for writer in ("a", "b")[: 1 + n % 2]:
            batch_id = n if writer == "a" else n // 2
            write(spark, root, writer, batch_id)
            expected += [(writer, batch_id, f"{writer}-{batch_id}-{i}") for i in range(3)]
        compact(spark, root, "rejects", NOW + timedelta(hours=n), fanout=2)
        assert content(spark, root) == sorted(expected)
    pinned = read_table(spark, root, "rejects")
    before = files(root)
    newest = all_generations(spark, root, "rejects")[-1]
    assert newest.marks == {"a": 4, "b": 0} and len(newest.segments) <= 3
    write(spark, root, "a", 7)
    compact(spark, root, "rejects", NOW + timedelta(days=2), fanout=2)
    # a reader that began before the last compaction reads on, whatever was added and cleared since
    vacuum(spark, root, "rejects", NOW + timedelta(days=1))
    assert sorted(map(tuple, pinned.select("writer", "batch_id", "key").collect())) == sorted(expected)
    expected += [("a", 7, f"a-7-{i}") for i in range(3)]
    assert content(spark, root) == sorted(expected)
    vacuum(spark, root, "rejects", NOW + timedelta(days=3))
    assert content(spark, root) == sorted(expected)
    assert len(all_generations(spark, root, "rejects")) == 1 and files(root) < before / 2
    left = {r.writer: r.batches for r in small_batches(spark, root, "rejects").collect()}
    assert left == {"a": 2, "b": 2}


def test_a_lost_compaction_changes_nothing(spark, root):
    for n in range(5):
        write(spark, root, "a", n)
    read_table(spark, root, "rejects").write.parquet(f"{root}/segments/log=rejects/lost")
    assert len(content(spark, root)) == 15
    assert vacuum(spark, root, "rejects", NOW) == 0
    generation = compact(spark, root, "rejects", NOW)
    assert len(content(spark, root)) == 15 and generation.marks == {"a": 2}
    # nothing new: the same generation
    assert compact(spark, root, "rejects", NOW).number == generation.number


def test_covered_folders_are_not_read(spark, root):
    for n in range(6):
        write(spark, root, "a", n)
    compact(spark, root, "rejects", NOW)
    read = read_table(spark, root, "rejects").inputFiles()
    plan = read_table(spark, root, "rejects")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and any("/segments/" in f for f in read)
    vacuum(spark, root, "rejects", NOW)
    folders = {f.split("batch_id=")[1].split("/")[0] for f in read_table(spark, root, "rejects").inputFiles() if "batch_id=" in f}
    assert folders == {"4", "5"}


def test_replay_after_a_compaction(spark, root):
    none = spark.createDataFrame([], "source_url string, reason string, body string")
    entry = (
        "SELECT 'a' source_name, 'a' source_url, 'g{0}' external_id, 'https://a.org/{0}' url, 't{0}' title,"
        " CAST(NULL AS string) author, CAST(NULL AS timestamp) published_at, 'python docker' content,"
        " map('k', 'v') raw_payload, {0} pos, '{0}' landed_seq"
    )

    def step(n):
        batch = Batch(spark, root, "feeds", n)
        pipeline.ingest_batch(batch, spark.sql(entry.format(n % 2)), none, batch.time(NOW + timedelta(hours=n)))

    for n in range(3):
        step(n)
    tables = ("raw_items", "items", "batch_done", "group_keys")
    before = {t: sorted(map(str, read_table(spark, root, t).drop("raw_payload").collect())) for t in tables}
    for t in tables:
        compact(spark, root, t, NOW)
        vacuum(spark, root, t, NOW)
    step(2)
    assert {t: sorted(map(str, read_table(spark, root, t).drop("raw_payload").collect())) for t in tables} == before
    assert len(before["items"]) == 2
