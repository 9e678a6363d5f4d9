"""How much of a text no earlier item has said, from sketches that are kept batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.upsert import seen_keys
from feedloom.session import materialize

WORDS = 3
# A sketch holds the shingles whose hash starts with one of these digits: a fourth of them.
KEPT_DIGITS = "0123"
KEY_DIGITS = 16


def sketch(text: Column | str, kept: str = KEPT_DIGITS) -> Column:
    """Keys of the text's distinct shingles of three words (a shorter text is one) that the sketch holds.

    Which shingles that are depends on the shingle alone, so sketches of all texts can be compared.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def build(found: Column) -> Column:
        last = F.greatest(F.size(found) - WORDS, F.lit(0))
        starts = F.when(F.size(found) > 0, F.sequence(F.lit(0), last))
        return F.transform(starts, lambda i: F.md5(F.array_join(F.slice(found, i + 1, WORDS), " ")))

    hashes = F.transform(F.array(words), build)[0]
    held = F.filter(F.array_distinct(hashes), lambda h: F.substring(h, 1, 1).isin(*kept))
    return F.transform(held, lambda h: F.substring(h, 1, KEY_DIGITS))


def novelty(rows: DataFrame, index: DataFrame, at: Column, row_id: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((row_id, n_sketch, n_new, novelty) of the rows, the keys they bring to the index).

    The novelty of a row is the share of its sketch that neither ``index`` (column ``key``, earlier
    batches) nor a row before it in the batch by ``at`` and id has. Batch by batch that is what one
    batch of all rows gives. It estimates the share over all shingles with a standard error of at
    most 0.5 / sqrt(n_sketch). Null, empty and very short texts whose sketch is empty have null.

    Every key meets its first row by a partial aggregate, so a phrase that all texts share is one row
    per task; the index is streamed against the batch's keys and not shuffled while those are small.
    """
    order = F.struct(at.alias("at"), F.col(row_id).alias("id"))
    sketched = materialize(rows.select(order.alias("place"), sketch(text).alias("keys")))
    keyed = sketched.select("place", F.explode("keys").alias("key"))
    first = materialize(keyed.groupBy("key").agg(F.min("place").alias("place")))
    added = materialize(first.join(seen_keys(index.select("key"), first, ["key"]), "key", "left_anti"))
    new = added.groupBy(F.col("place.id").alias("__id")).agg(F.count("*").alias("__new"))
    size = F.coalesce(F.size("keys"), F.lit(0))
    counted = sketched.select(F.col("place.id").alias(row_id), F.greatest(size, F.lit(0)).cast("long").alias("n_sketch"))
    joined = counted.join(new, F.col(row_id) == F.col("__id"), "left")
    fresh = F.coalesce("__new", F.lit(0))
    share = F.when(F.col("n_sketch") > 0, F.round(fresh / F.col("n_sketch"), 3).cast("decimal(4,3)"))
    return joined.select(row_id, "n_sketch", fresh.alias("n_new"), share.alias("novelty")), added.select("key")
