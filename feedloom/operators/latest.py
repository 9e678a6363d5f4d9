"""Top rows per key: latest row, first N of a feed, newest N of a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.skew import row_salt

# Up to this many rows per key, Spark prunes each map task's rows before the shuffle.
GROUP_LIMIT = 1000
SALTS = 4096


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per key; the rank column is kept.

    For larger ``n`` than Spark prunes by itself, a salted first round cuts hot keys.
    """
    if n > GROUP_LIMIT:
        salted = df.withColumn("__salt", row_salt(df, SALTS))
        df = _ranked(salted, [*keys, "__salt"], order, n, rank).drop("__salt", rank)
    return _ranked(df, keys, order, n, rank)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_n_per_key(df, keys, order, 1, "__rank").drop("__rank")


def left_join_latest(
    left: DataFrame, log: DataFrame, key: str, order: list[Column], columns: list[str]
) -> DataFrame:
    """Left join to the latest log row per key, as a lateral top-1 would give."""
    newest = latest_per_key(log, [key], order).select(key, *columns)
    return left.join(newest, key, "left")
