"""Duplicate groups under "same URL or same hash"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import distinct_keys, left_join_unique
from feedloom.session import materialize


def _first_of_key(rows: DataFrame, key: str, at: str, item_id: str, name: str) -> DataFrame:
    """The earliest row of every key that occurs more than once."""
    return (
        rows.groupBy(key)
        .agg(F.min(F.struct(at, item_id)).alias(name), F.count("*").alias("__n"))
        .filter("__n > 1")
        .select(F.col(key).alias(f"__{key}"), name, "__n")
    )


def duplicate_parents(
    rows: DataFrame, url: str, content: str, at: str = "created_at", item_id: str = "id"
) -> DataFrame:
    """(id, created_at, parent_id): the earliest earlier row that shares the URL or the hash.

    The disjunction is two aggregates on one key each, joined back; no pair of duplicates is
    ever listed. The four narrow columns are written once, so that texts behind the hash are read
    a single time.
    """
    narrow = materialize(rows.select(item_id, at, url, content))
    by_url = _first_of_key(narrow, url, at, item_id, "__by_url")
    by_hash = _first_of_key(narrow, content, at, item_id, "__by_hash")
    linked = left_join_unique(narrow, by_url, url, f"__{url}", "__n")
    linked = left_join_unique(linked, by_hash, content, f"__{content}", "__n")
    first = F.least("__by_url", "__by_hash")
    earlier = first < F.struct(at, item_id)
    return linked.select(item_id, at, F.when(earlier, first[item_id]).alias("parent_id"))


def resolve_roots(links: DataFrame, item_id: str = "id") -> DataFrame:
    """(id, parent_id, group_id): follow parent links to the first item of each group.

    Pointer jumping over the few rows that are parents and have a parent themselves; every round
    halves the remaining distance and is written to shared storage.
    """
    children = links.filter(F.col("parent_id").isNotNull())
    parents = distinct_keys(children, "parent_id").withColumnRenamed("parent_id", item_id)
    hops = materialize(
        children.join(parents, item_id, "left_semi").select(
            F.col(item_id).alias("node"), F.col("parent_id").alias("target")
        )
    )
    # none where no parent has a parent
    moved = not hops.isEmpty()
    while moved:
        onward = hops.select(F.col("node").alias("__node"), F.col("target").alias("__next"))
        jumped = left_join_unique(hops.select("node", "target"), onward, "target", "__node")
        hops = materialize(
            jumped.select(
                "node",
                F.coalesce("__next", "target").alias("target"),
                F.col("__next").isNotNull().alias("moved"),
            )
        )
        moved = not hops.filter("moved").isEmpty()
    roots = hops.select(F.col("node").alias("__node"), F.col("target").alias("__root"))
    joined = left_join_unique(links, roots, "parent_id", "__node")
    return joined.select(
        *links.columns, F.coalesce("__root", "parent_id", item_id).alias("group_id")
    )


def dedupe_groups(
    rows: DataFrame, url: str, content: str, at: str = "created_at", item_id: str = "id"
) -> DataFrame:
    """(id, created_at, parent_id, group_id, status): members of a group point to its first item."""
    links = materialize(duplicate_parents(rows, url, content, at, item_id))
    status = F.when(F.col("parent_id").isNotNull(), "ignored").otherwise("new")
    return resolve_roots(links, item_id).withColumn("status", status)
