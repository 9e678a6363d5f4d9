"""Generations of a log: many small batches as few files, beside running readers.

A generation is a list of segments, Parquet folders that hold the rows of ranges of done batches. It
is written down in a manifest after its segments, so a lost compaction leaves the generation before in
force. Segments hold exactly the rows of the batches they cover: it makes no difference to a reader, or
to a batch that runs again, which generation it has found. Folders that a generation replaces stay
until ``vacuum``, for readers that found the one before. One compaction of a log runs at a time.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schemas import TABLE_COLUMNS
from feedloom.streaming.tables import (
    MANIFEST,
    Generation,
    Segment,
    logged_rows,
    manifest_path,
    newest_generation,
    read_table,
    segment_rows,
    uncovered,
)

# A writer's last batches stay as they are: one may run again and reads its own and the one before.
KEEP_BATCHES = 2
# Segments of one level that are merged into one of the next, so a row is written once per level.
FANOUT = 8
FILE_BYTES = 256 << 20


def _ordered(rows: DataFrame, table: str) -> DataFrame:
    """Rows in files of about ``FILE_BYTES``, by writer and batch, whose ranges readers ask for.

    A large batch is spread over files by the hash of its first column.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spread = F.xxhash64(TABLE_COLUMNS[table][0])
    files = rows.repartitionByRange(1 + size // FILE_BYTES, "writer", "batch_id", spread)
    return files.sortWithinPartitions("writer", "batch_id")


def compact(
    spark: SparkSession, root: str, table: str, now: datetime, keep: int = KEEP_BATCHES, fanout: int = FANOUT
) -> Generation | None:
    """Put the batches done since the generation before into a segment; returns the generation in force."""
    before = newest_generation(spark, root, table)
    marks = before.marks if before else {}
    done = read_table(spark, root, "batch_done").groupBy("writer").agg(F.max("batch_id").alias("last"))
    fresh = {
        row["writer"]: (marks.get(row["writer"], -1) + 1, row["last"] - keep)
        for row in done.collect()
        if row["last"] - keep > marks.get(row["writer"], -1)
    }
    live = logged_rows(spark, root, table)
    if live is None or not fresh:
        return before
    kept, level = list(before.segments) if before else [], 0
    merged: list[Segment] = []
    while len(same := [s for s in kept if s.level == level]) >= fanout - 1:
        merged += same
        kept = [s for s in kept if s.level != level]
        level += 1
    wanted = F.lit(False)
    for writer, (first, last) in sorted(fresh.items()):
        wanted = wanted | ((F.col("writer") == writer) & F.col("batch_id").between(first, last))
    rows = live.filter(wanted)
    if merged:
        rows = rows.unionByName(segment_rows(spark, table, merged))
    path = f"{root}/segments/log={table}/{uuid.uuid4().hex}"
    _ordered(rows, table).write.parquet(path)
    last = {writer: last for segment in merged for writer, last in segment.last.items()}
    for segment in merged:
        last |= {w: max(last[w], n) for w, n in segment.last.items()}
    last |= {writer: until for writer, (_, until) in fresh.items()}
    return _publish(spark, root, table, [*kept, Segment(path, level, last)], before, now)


def _publish(
    spark: SparkSession, root: str, table: str, segments: list[Segment], before: Generation | None, now: datetime
) -> Generation:
    """Write the manifest as one file, which readers see whole or not at all."""
    generation = Generation(before.number + 1 if before else 0, now.astimezone(timezone.utc), tuple(segments))
    rows = [(s.path, s.level, writer, last) for s in segments for writer, last in s.last.items()]
    listed = spark.createDataFrame(rows, "segment string, level int, writer string, last_batch bigint")
    stamped = listed.withColumn("created_at", F.lit(now).cast("timestamp"))
    columns = [part.split()[0] for part in MANIFEST.split(",")]
    stamped.select(*columns).coalesce(1).write.parquet(f"{manifest_path(root, table)}/generation={generation.number}")
    return generation


def vacuum(spark: SparkSession, root: str, table: str, before: datetime) -> int:
    """Delete what the last generation written by ``before`` replaces; returns the number of folders.

    Readers that began earlier than that must have come to their end. A listing that runs at the same
    moment may miss a folder under it and fail; it finds all rows when it runs again.
    """
    generations = all_generations(spark, root, table)
    ripe = [g for g in generations if g.created_at <= before.astimezone(timezone.utc)]
    if not ripe:
        return 0
    pinned = ripe[-1]
    used = {s.path for g in generations if g.number >= pinned.number for s in g.segments}
    old = [g for g in ripe if g.number < pinned.number]
    doomed = [f"{manifest_path(root, table)}/generation={g.number}" for g in old]
    doomed += sorted({s.path for g in old for s in g.segments} - used)
    for writer, last in pinned.marks.items():
        folder = f"{root}/{table}/writer={writer}"
        numbers = [int(name.split("=")[1]) for name in _children(spark, folder) if name.startswith("batch_id=")]
        doomed += [f"{folder}/batch_id={n}" for n in numbers if n <= last]
    for folder in doomed:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(doomed)


def all_generations(spark: SparkSession, root: str, table: str) -> list[Generation]:
    """The generations whose manifests are still there, oldest first."""
    newest = newest_generation(spark, root, table)
    if newest is None:
        return []
    older = (newest_generation(spark, root, table, number) for number in range(newest.number))
    return [g for g in older if g is not None] + [newest]


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def small_batches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(writer, batches): batches of a log outside the generation in force, a measure of when to compact."""
    live = logged_rows(spark, root, table)
    if live is None:
        return spark.createDataFrame([], "writer string, batches bigint")
    generation = newest_generation(spark, root, table)
    rest = live if generation is None else live.filter(uncovered(generation))
    return rest.groupBy("writer").agg(F.countDistinct("batch_id").alias("batches"))
