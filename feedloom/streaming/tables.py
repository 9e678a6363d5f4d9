"""Append-only Parquet logs, one folder per writer and batch."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schemas import TABLE_COLUMNS, TABLES


@dataclass(frozen=True)
class Batch:
    """One unit of work of one writer; running it again replaces its own rows.

    A batch reads its writer's earlier batches, and of other writers those that were done when it
    first ran. That is written down, so a replay reads the same rows whatever was added since.
    """

    spark: SparkSession
    root: str
    writer: str
    batch_id: int

    @cached_property
    def visible(self) -> dict[str, int]:
        """The last batch to read of each other writer; one entry per writer."""
        if self.own("batch_views") is None:
            done = read_table(self.spark, self.root, "batch_done").filter(F.col("writer") != self.writer)
            last = done.groupBy(F.col("writer").alias("seen_writer")).agg(F.max("batch_id").alias("seen_batch"))
            self.write("batch_views", last)
        return self._marks(self.batch_id)

    def _rows(self, table: str, last_own: int) -> DataFrame:
        wanted = (F.col("writer") == self.writer) & (F.col("batch_id") <= last_own)
        for writer, batch_id in sorted(self.visible.items()):
            wanted = wanted | ((F.col("writer") == writer) & (F.col("batch_id") <= batch_id))
        return read_table(self.spark, self.root, table).filter(wanted)

    def prior(self, table: str) -> DataFrame:
        """Rows of this writer's earlier batches and of what it may read of other writers."""
        return self._rows(table, self.batch_id - 1)

    def all(self, table: str) -> DataFrame:
        """Prior rows and those this batch has written so far."""
        return self._rows(table, self.batch_id)

    def new(self, table: str) -> DataFrame:
        """Rows of other writers' batches that this batch may read and the one before could not."""
        before = self._marks(self.batch_id - 1)
        wanted = F.lit(False)
        for writer, batch_id in sorted(self.visible.items()):
            later = (F.col("batch_id") > before.get(writer, -1)) & (F.col("batch_id") <= batch_id)
            wanted = wanted | ((F.col("writer") == writer) & later)
        return read_table(self.spark, self.root, table).filter(wanted)

    def current(self, table: str) -> DataFrame:
        """All rows that any writer has written by now, done or not; for leases alone."""
        return read_table(self.spark, self.root, table)

    def _marks(self, batch_id: int) -> dict[str, int]:
        marks = Batch(self.spark, self.root, self.writer, batch_id).own("batch_views")
        return {} if marks is None else {row["seen_writer"]: row["seen_batch"] for row in marks.collect()}

    def own(self, table: str) -> DataFrame | None:
        """What an earlier run of this batch has written of a table, if it came so far."""
        folder = f"{self.root}/{table}/writer={self.writer}/batch_id={self.batch_id}"
        return _parquet(self.spark, TABLES[table], folder)

    def done(self, now: datetime) -> None:
        """Let other writers' later batches read this one."""
        self.write("batch_done", self.spark.range(1).select(F.lit(now).cast("timestamp").alias("done_at")))

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Replace this batch's rows of a table and read them back, so later steps reuse them."""
        folder = f"{self.root}/{table}/writer={self.writer}/batch_id={self.batch_id}"
        rows.select(*TABLE_COLUMNS[table]).write.mode("overwrite").parquet(folder, compression="zstd")
        return self.spark.read.schema(TABLES[table]).parquet(folder)

    def last_time(self, now: datetime) -> datetime | None:
        """The time of this writer's batch before, in the zone of ``now``."""
        marks = read_table(self.spark, self.root, "batch_times").filter(
            (F.col("writer") == self.writer) & (F.col("batch_id") == self.batch_id - 1)
        )
        known = marks.select(F.unix_micros("batch_at")).head()
        return None if known is None else datetime.fromtimestamp(known[0] / 1_000_000, tz=now.tzinfo)

    def time(self, now: datetime) -> datetime:
        """The time of this batch: ``now`` on the first run, the same again on a replay."""
        mark = read_table(self.spark, self.root, "batch_times").filter(
            (F.col("writer") == self.writer) & (F.col("batch_id") == self.batch_id)
        )
        known = mark.select(F.unix_micros("batch_at")).head()
        if known is None:
            row = self.spark.range(1).select(F.lit(now).cast("timestamp").alias("batch_at"))
            known = self.write("batch_times", row).select(F.unix_micros("batch_at")).head()
        return datetime.fromtimestamp(known[0] / 1_000_000, tz=now.tzinfo)


def next_batch(spark: SparkSession, root: str, writer: str) -> Batch:
    """The writer's next batch, or its last one if that did not come to its end."""

    def last(table: str) -> int:
        rows = read_table(spark, root, table).filter(F.col("writer") == writer)
        return rows.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]

    return Batch(spark, root, writer, max(last("batch_times"), last("batch_done") + 1))


@dataclass(frozen=True)
class Segment:
    """A folder with the rows of each writer's batches up to ``last``, beyond those of earlier segments."""

    path: str
    level: int
    last: dict[str, int]


@dataclass(frozen=True)
class Generation:
    """The compacted part of a log; see ``feedloom.streaming.compaction``."""

    number: int
    created_at: datetime
    segments: tuple[Segment, ...]

    @cached_property
    def marks(self) -> dict[str, int]:
        """The last batch of each writer that the segments hold."""
        marks: dict[str, int] = {}
        for segment in self.segments:
            for writer, last in segment.last.items():
                marks[writer] = max(last, marks.get(writer, -1))
        return marks


MANIFEST = "segment string, level int, writer string, last_batch bigint, created_at timestamp"


def manifest_path(root: str, table: str) -> str:
    return f"{root}/manifests/log={table}"


def _parquet(spark: SparkSession, ddl: str, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_generation(spark: SparkSession, root: str, table: str, number: int | None = None) -> Generation | None:
    """The generation in force, or the one of a number; one row per segment and writer is read."""
    listed = _parquet(spark, f"{MANIFEST}, generation bigint", manifest_path(root, table))
    if listed is None:
        return None
    at = F.unix_micros("created_at").alias("at")
    wanted = listed if number is None else listed.filter(F.col("generation") == number)
    rows = wanted.select("generation", "segment", "level", "writer", "last_batch", at).collect()
    if not rows:
        return None
    newest = max(row["generation"] for row in rows)
    found: dict[tuple[int, str], dict[str, int]] = {}
    for row in rows:
        if row["generation"] == newest:
            found.setdefault((row["level"], row["segment"]), {})[row["writer"]] = row["last_batch"]
            micros = row["at"]
    segments = tuple(Segment(path, level, last) for (level, path), last in sorted(found.items()))
    return Generation(newest, datetime.fromtimestamp(micros / 1_000_000, tz=timezone.utc), segments)


def uncovered(generation: Generation) -> Column:
    """Whether a row's batch is outside the generation; on partition columns, so its folders are not read."""
    outside = F.lit(True)
    for writer, last in sorted(generation.marks.items()):
        outside = outside & ~((F.col("writer") == writer) & (F.col("batch_id") <= last))
    return outside


def log_ddl(table: str) -> str:
    return f"{TABLES[table]}, writer string, batch_id bigint"


def logged_rows(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Rows in the folders of batches."""
    return _parquet(spark, log_ddl(table), f"{root}/{table}")


def segment_rows(spark: SparkSession, table: str, segments: list[Segment] | tuple[Segment, ...]) -> DataFrame:
    return spark.read.schema(log_ddl(table)).parquet(*[s.path for s in segments])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a log; none before its first batch.

    Batches of the generation in force come from its segments, the others from their folders.
    """
    generation = newest_generation(spark, root, table)
    live = logged_rows(spark, root, table)
    if generation is None:
        return spark.createDataFrame([], log_ddl(table)) if live is None else live
    rows = segment_rows(spark, table, generation.segments)
    return rows if live is None else rows.unionByName(live.filter(uncovered(generation)))
