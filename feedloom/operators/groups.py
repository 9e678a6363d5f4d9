"""Duplicate groups that grow by batches over a stored index of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.dedupe import duplicate_parents, resolve_roots
from feedloom.operators.latest import latest_per_key
from feedloom.operators.skew import distinct_keys, left_join_unique
from feedloom.session import materialize

KEYS = ("url_key", "content_key")


def _known(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Index entries of the batch's keys; the index is the streamed side and stays where it is."""
    wanted = distinct_keys(rows.select(F.explode(F.array(*KEYS)).alias("key")), "key")
    return index.join(wanted, "key", "left_semi")


def join_groups(rows: DataFrame, index: DataFrame, new_group: Column) -> tuple[DataFrame, DataFrame]:
    """Groups of a batch's rows, and the index entries they add.

    ``rows`` has a unique id, at (any ordered value, later than all of the index), url_key and
    content_key, either of which may be null. ``index`` has one entry (key, at, group_id) per key
    seen: its first row. A row joins the group of the earliest other row that has its URL or its
    content; a row without one opens a group, named by ``new_group`` over its columns.

    Stored groups never change, so a batch reads only the entries of its own keys: the rows with a
    stored key take that group, the others find the first such row of the batch by pointer jumping.
    Grouping a table at once or in any number of consecutive batches gives the same groups.

    Returns (id, group_id, is_duplicate) and (key, at, group_id, id).
    """
    narrow = materialize(rows.select("id", "at", *KEYS, new_group.alias("own_group")))
    hits = materialize(_known(narrow, index.select("key", "at", "group_id")))
    found = narrow
    for key in KEYS:
        entry = F.struct(F.col("at").alias("at"), F.col("group_id").alias("group_id")).alias(f"by_{key}")
        found = left_join_unique(found, hits.select(F.col("key").alias("__key"), entry), key, "__key")
    stored = F.least(*[f"by_{key}" for key in KEYS])["group_id"]
    found = materialize(found.select("id", "own_group", stored.alias("stored_group")))
    links = materialize(duplicate_parents(narrow, "url_key", "content_key", "at"))
    marked = links.join(found, "id")
    # what joins a stored group is a root of the batch
    parent = F.when(F.col("stored_group").isNull(), F.col("parent_id"))
    rooted = resolve_roots(marked.withColumn("parent_id", parent))
    named = found.select(F.col("id").alias("root"), F.coalesce("stored_group", "own_group").alias("root_group"))
    grouped = left_join_unique(rooted.withColumnRenamed("group_id", "root_id"), named, "root_id", "root")
    duplicate = F.col("stored_group").isNotNull() | F.col("parent_id").isNotNull()
    grouped = materialize(grouped.select("id", F.col("root_group").alias("group_id"), duplicate.alias("is_duplicate")))
    keyed = narrow.select("id", "at", F.explode(F.array(*KEYS)).alias("key")).filter("key IS NOT NULL")
    first = latest_per_key(keyed, ["key"], [F.col("at"), F.col("id")]).join(hits.select("key"), "key", "left_anti")
    return grouped, first.join(grouped.select("id", "group_id"), "id").select("key", "at", "group_id", "id")
