"""Rows from elsewhere into the pipeline's logs, behind the logs' constraints."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.checks import Constraints, check_batch
from feedloom.schemas import DOMAINS, FOREIGN_KEYS, TABLE_COLUMNS, UNIQUE_KEYS
from feedloom.session import materialize
from feedloom.streaming.tables import Batch

# Logs that hold several versions of a row; their keys are unique in the current rows, not in the log.
VERSIONED = ("sources", "raw_items", "notes")


def checked_rows(batch: Batch, table: str, rows: DataFrame) -> DataFrame:
    """The rows with ``refused``, by the table's domains, references and keys against earlier batches.

    A table's keys are asked one after the other, each of the rows that are still good: a row that
    the second key refuses has taken its first key from later rows of the batch.
    """
    columns = TABLE_COLUMNS[table]
    prior = batch.prior(table)
    references = {
        column: (batch.prior(parent), key) for child, column, parent, key in FOREIGN_KEYS if child == table
    }
    domains = {c: allowed for (name, c), allowed in DOMAINS.items() if name == table and c in columns}
    row_id = ["id"] if "id" in columns else []
    checked = check_batch(rows, Constraints(row_id, domains, references))
    if table in VERSIONED:
        return checked
    for key in [row_id, *[k for name, k in UNIQUE_KEYS if name == table]]:
        if key:
            good = checked.filter("refused IS NULL").drop("refused")
            asked = check_batch(good, Constraints(unique=key, order=[*row_id, "created_at"]), prior)
            checked = materialize(asked.unionByName(checked.filter("refused IS NOT NULL")))
    return checked


def import_rows(batch: Batch, table: str, rows: DataFrame, now: datetime) -> DataFrame:
    """Write what the table's constraints allow as the batch's rows; the rest goes to ``rejects`` as JSON.

    A batch imports one table. A replay reads the same earlier batches and so decides alike.
    """
    checked = materialize(checked_rows(batch, table, rows.select(*TABLE_COLUMNS[table])))
    logged = batch.write(table, checked.filter("refused IS NULL"))
    detail = F.to_json(F.struct(*TABLE_COLUMNS[table]))
    key = F.col("id") if "id" in TABLE_COLUMNS[table] else F.lit(None).cast("string")
    refused = checked.filter("refused IS NOT NULL").select(
        F.lit(f"import {table}").alias("stage"),
        key.alias("key"),
        F.col("refused").alias("reason"),
        detail.alias("detail"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )
    batch.write("rejects", refused)
    batch.done(now)
    return logged
