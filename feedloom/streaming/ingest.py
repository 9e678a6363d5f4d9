"""Structured Streaming around the batch steps."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.ingest import head_over_pages
from feedloom.session import materialize
from feedloom.sources.feeds import parse_feed_rows, split_rows, stream_landed
from feedloom.sources.reader import parse_reader_rows
from feedloom.streaming.pipeline import Options, feedback_batch, ingest_batch
from feedloom.streaming.tables import Batch

Clock = Callable[[], datetime]


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def ingest_landed(
    batch: Batch, landed: DataFrame, now: datetime, options: Options = Options(), reader_api: bool = False
) -> None:
    """Parse one batch of landed documents and run the pipeline on it.

    The limit of a feed holds per document; with ``options.pages`` the documents of a feed in one
    batch are pages of one fetch and share it.
    """
    parse = parse_reader_rows if reader_api else parse_feed_rows
    found = split_rows(materialize(parse(landed, head=options.max_items_per_feed)))
    items = found.items
    if options.pages:
        items = head_over_pages(items, n=options.max_items_per_feed)
    ingest_batch(batch, items, found.rejects, now, options)


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    options: Options = Options(),
    clock: Clock = utc_now,
    reader_api: bool = False,
    max_files: int | None = None,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Stream landed documents; without ``processing_time`` it stops when all files are read."""
    writer = "reader" if reader_api else "feeds"

    def step(landed: DataFrame, batch_id: int) -> None:
        batch = Batch(landed.sparkSession, root, writer, batch_id)
        ingest_landed(batch, landed, batch.time(clock()), options, reader_api)

    stream = stream_landed(spark, landing, max_files).writeStream.foreachBatch(step)
    return _start(stream, checkpoint, processing_time)


def start_feedback(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    options: Options = Options(),
    clock: Clock = utc_now,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Stream landed callbacks, one JSON object per line."""

    def step(lines: DataFrame, batch_id: int) -> None:
        batch = Batch(lines.sparkSession, root, "feedback", batch_id)
        feedback_batch(batch, lines.withColumnRenamed("value", "payload"), batch.time(clock()), options)

    stream = spark.readStream.text(landing).writeStream.foreachBatch(step)
    return _start(stream, checkpoint, processing_time)


def _start(stream, checkpoint: str, processing_time: str | None) -> StreamingQuery:
    writer = stream.option("checkpointLocation", checkpoint)
    if processing_time is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()
