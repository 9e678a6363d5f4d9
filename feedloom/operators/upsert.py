"""Upserts on append-only logs: unseen keys, latest-wins and first/last merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.latest import latest_per_key
from feedloom.operators.skew import distinct_keys, left_join_unique


def seen_keys(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's keys that the table already holds.

    The table is the streamed side: with a batch under the broadcast threshold it is scanned
    in place and never shuffled.
    """
    return distinct_keys(existing.join(distinct_keys(batch, *keys), keys, "left_semi"), *keys)


def unseen(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key the table does not hold yet; rows with a null in the key are unseen.

    The batch side of the join is spread where one key holds many rows.
    """
    seen = seen_keys(existing, batch, keys)
    key = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    known = seen.select(key.alias("__seen_key"), F.lit(True).alias("__seen"))
    keyed = batch.withColumn("__key", F.when(whole, key))
    joined = left_join_unique(keyed, known, "__key", "__seen_key")
    return joined.filter(F.col("__seen").isNull()).select(*[F.col(f"`{c}`") for c in batch.columns])


def insert_if_absent(
    batch: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """Rows to append: the first batch row per key that the table does not hold yet.

    Copies are pruned before any shuffle, so a key with many of them costs one row per task.
    """
    first = latest_per_key(batch, keys, order)
    return first.join(seen_keys(existing, batch, keys), keys, "left_anti")


def merge_first_last(
    versions: DataFrame,
    keys: list[str],
    order: list[str],
    first: list[str],
    last: list[str],
) -> DataFrame:
    """Current row per key: ``first`` columns from the oldest version, ``last`` from the newest."""
    at = F.struct(*order)
    merged = versions.groupBy(*keys).agg(
        F.min_by(F.struct(*first), at).alias("__first"),
        F.max_by(F.struct(*last), at).alias("__last"),
        F.count("*").alias("n_versions"),
    )
    return merged.select(*keys, "__first.*", "__last.*", "n_versions")


def flag_key_conflicts(
    rows: DataFrame, key: list[str], identity: str, order: list[str]
) -> DataFrame:
    """Add ``conflict``: another identity came first under the same unique key."""
    at = F.struct(*order, identity)
    keyed = rows.withColumn("__key", F.to_json(F.struct(*key)))
    owners = (
        keyed.groupBy("__key")
        .agg(F.min(at).alias("__owner"), F.count("*").alias("__n"))
        .filter("__n > 1")
        .select(
            F.col("__key").alias("__owner_key"),
            F.col(f"__owner.{identity}").alias("__owner_id"),
            "__n",
        )
    )
    joined = left_join_unique(keyed, owners, "__key", "__owner_key", "__n")
    return joined.withColumn(
        "conflict", F.coalesce(F.col("__owner_id") != F.col(identity), F.lit(False))
    ).drop("__key", "__owner_id")
