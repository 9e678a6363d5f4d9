"""Mix sources to target weights: capped shares, hash-random order, distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.names import free_names
from feedloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
# Documents per range of the random order; a range is one window partition.
RANGE_ROWS = 4096
KEY_BITS = 60


def random_key(doc_id: Column, seed: str) -> Column:
    """Hash-random, the same for the same id and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """(doc_id, source, size, key)."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        random_key(F.col(doc_id), seed).alias("key"),
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``position``: the place by code point, null last, without one task seeing all sources."""
    placed = materialize(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("inside"),
        )
    )
    # one row per partition
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return placed.join(offsets, F.col("part") == F.col("__part")).select(
        *sources.columns, (F.col("inside") + F.col("offset")).alias("position")
    )


def source_targets(
    sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int
) -> DataFrame:
    """Adds ``target``: the share of all words by weight, never above ``most`` times the source.

    Each round is one aggregate over the sources; a source that reaches its limit stays there, so
    the level only rises and the rounds end when no further source is above its limit.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = materialize(
        _ranked(sources).select(
            "source", "source_size", "n_docs",
            cycle.cast("double").alias("weight"),
            (F.col("source_size") * most).cast("double").alias("limit"),
        )
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget = total * share[0] / share[1]
    level = 0.0
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        spent, open_weight = weighed.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        raised = (budget - spent) / open_weight
        if raised <= level:
            break
        level = raised
    return weighed.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).drop("weight", "limit")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row.

    Sources in code point order (null last) take the weights in turn. They share ``share`` of all
    words; a target stops at ``most`` times its source and the excess goes to the others by weight.
    A source goes through its documents in hash-random order, whole epochs first, and is cut at the
    whole words of its target: ``taken`` of the document at the cut counts the words up to it.

    The order is cut into ranges of about ``RANGE_ROWS`` documents each, so that a source of any
    size is spread; a prefix sum over the ranges' totals joins them.

    Null and empty texts have size 0 and take 0; null sources are one source; null ids are ordered
    like any id. Rows with the same id are ordered by size, and equal rows may stand for each other.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    mixed = _mixed(docs, doc_id, text, source, weights, share, most, seed)
    taken = (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken")
    return mixed.select("doc_id", "source", "size", "source_size", "target", taken)


def _mixed(docs, doc_id, text, source, weights=(3, 1, 2), share=(3, 2), most=2, seed="mix") -> DataFrame:
    """The mix with the random key, the source's whole epochs, and the words taken in its last, partial one."""
    rows = materialize(with_sizes(docs, doc_id, text, source, seed))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialize(
        source_targets(sources, weights, share, most).select(
            F.col("source").alias("__source"), "source_size", "target",
            F.ceil(F.col("n_docs") / RANGE_ROWS).alias("n_ranges"),
        )
    )
    high = F.shiftright("key", KEY_BITS - 30)
    # the few columns of a source go to the rows; Spark broadcasts them below its size threshold
    placed = materialize(
        rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).select(
            "doc_id", "source", "size", "key", "source_size", "target",
            F.shiftright(high * F.col("n_ranges"), 30).alias("range"),
        )
    )
    totals = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("__source"), F.col("range").alias("__range"),
        F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = (
        Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    summed = running.join(
        offsets,
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range")),
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("inside") - F.col("offset"), F.lit(0)), F.col("size"))
    return summed.withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "source_size", "target", "key", "epochs", last.alias("last")
    )


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "mix",
    **mix,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns unchanged.

    A document that the mix takes in part is not torn: it comes once more as a whole, so a source
    may run over its target by less than one document. Documents of which nothing is taken go.
    Rows with the same id, source and size come equally often. Nulls are handled as in the mix, null
    and empty texts go. Columns of any name keep their values; an empty table stays empty.

    What a source takes in its last epoch is a range of the random order, so its end is all that
    the rows have to know: one row per source goes to the texts, which do not move.
    """
    order = ["key", "doc_id", "size"]
    own, epochs, cut, at, times, epoch = free_names(docs, "source", "epochs", "cut", "place", "times", "epoch")
    mixed = _mixed(docs, doc_id, text, source, seed=seed, **mix)
    cuts = materialize(
        mixed.groupBy(F.col("source").alias(own)).agg(
            F.max("epochs").alias(epochs),
            F.max(F.when(F.col("last") > 0, F.struct(*order))).alias(cut),
        )
    )
    whole = F.col(source).cast("string")
    key, size = random_key(F.col(doc_id), seed), word_count(F.col(text))
    place = F.struct(key.alias("key"), F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"))
    joined = docs.withColumn(at, place).join(cuts, whole.eqNullSafe(F.col(own)))
    again = F.coalesce((F.col(at) <= F.col(cut)).cast("int"), F.lit(0))
    often = F.when(F.col(at)["size"] > 0, F.col(epochs).cast("int") + again).otherwise(0)
    kept = joined.withColumn(times, often).filter(F.col(times) > 0)
    numbered = kept.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times))))
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns])
