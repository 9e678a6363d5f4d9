"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000
HOT_SALTS = 4096


def row_salt(df: DataFrame, salts: int) -> Column:
    """A number below ``salts`` from the row's own values, the same whenever a task runs again."""
    values = [name for name, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    return F.pmod(F.xxhash64(*values), F.lit(salts))


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys above the hot share; fewer than ``HOT_SHARE`` rows by construction.

    The largest counts and their sum come from one aggregate, whose exchange Spark reuses.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    largest = counts.orderBy(F.col("__n").desc()).limit(HOT_SHARE)
    return largest.filter(F.col("__n") * HOT_SHARE > total).select(key)


def broadcastable(df: DataFrame) -> bool:
    """Whether Spark's estimate of the table's size is under the session's broadcast threshold.

    For a written table that is the size of its files, for filters and aggregates over it a bound.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size <= threshold


def left_join_unique(
    fact: DataFrame, dim: DataFrame, key: str, dim_key: str, weight: str | None = None
) -> DataFrame:
    """``fact LEFT JOIN dim`` where ``dim`` has one narrow row per key.

    Rows of hot keys meet their dim row through a broadcast bounded by ``HOT_SHARE`` rows. In the
    shuffle join, which is on key and salt, they and rows without a key carry a spreading salt that
    matches nothing. ``weight`` names a dim column that already holds the fact's row count per key,
    which saves counting it again; it is not part of the result. A dim under the broadcast threshold
    goes to the fact, of which then nothing moves and nothing is counted.
    """
    columns = [c for c in dim.columns if c not in (dim_key, weight)]
    if broadcastable(dim):
        whole = dim.select(F.col(dim_key).alias("__dim_key"), *[F.col(c).alias(f"__dim_{c}") for c in columns])
        joined = fact.join(F.broadcast(whole), F.col(key) == F.col("__dim_key"), "left")
        return joined.select(*fact.columns, *[F.col(f"__dim_{c}").alias(c) for c in columns])
    if weight is None:
        keys = hot_keys(fact, key).withColumnRenamed(key, "__hot_key")
        own = dim.join(F.broadcast(keys), F.col(dim_key) == F.col("__hot_key"), "left_semi")
        # a hot key without a dim row is spread as well
        hot = keys.join(own, F.col(dim_key) == F.col("__hot_key"), "left").drop(dim_key)
        hot = hot.withColumnRenamed("__hot_key", dim_key)
    else:
        hot = dim.filter(F.col(weight) * HOT_SHARE > dim.agg(F.sum(weight)).scalar())
    hot = hot.select(
        F.col(dim_key).alias("__hot_key"),
        *[F.col(c).alias(f"__hot_{c}") for c in columns],
    )
    marked = fact.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    spread = F.col("__hot_key").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("__salt", F.when(spread, 1 + row_salt(fact, HOT_SALTS)).otherwise(0))
    cold = dim.select(
        F.col(dim_key).alias("__dim_key"),
        # always 0, but not a constant: a constant would be taken out of the join's keys
        F.pmod(F.xxhash64(dim_key), F.lit(1)).alias("__dim_salt"),
        *[F.col(c).alias(f"__dim_{c}") for c in columns],
    )
    joined = marked.join(
        cold,
        (F.col(key) == F.col("__dim_key")) & (F.col("__salt") == F.col("__dim_salt")),
        "left",
    )
    return joined.select(
        *fact.columns,
        *[F.coalesce(f"__hot_{c}", f"__dim_{c}").alias(c) for c in columns],
    )


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key set with map-side combine, so a hot key reaches a semi or anti join once per task."""
    return df.select(*keys).filter(F.col(keys[0]).isNotNull()).distinct()
