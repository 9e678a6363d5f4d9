"""Constraint checks: over whole tables, and of a batch before it is written."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import distinct_keys, left_join_unique
from feedloom.session import materialize


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(value, n_rows) for each value outside the domain; null passes."""
    return (
        df.filter(~F.col(column).isin(allowed))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n_rows"))
    )


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) for each non-null key that occurs more than once."""
    not_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(not_null).groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = distinct_keys(parent, parent_key).withColumnRenamed(parent_key, "__parent")
    return child.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__parent"), "left_anti")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_nulls) in one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_nulls")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls replaced by their declared default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of every table."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def missing_keys(required: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct required rows that are not present."""
    return required.subtract(present)


@dataclass(frozen=True)
class Constraints:
    """What a batch must satisfy. A null passes all but ``not_null``, as in SQL.

    ``unique`` is one key; its first row in ``order`` stays. ``references`` maps a column to the table
    and column that must hold its value.
    """

    not_null: list[str] = field(default_factory=list)
    domains: dict[str, list] = field(default_factory=dict)
    references: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)


def _with_held(rows: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: true where the table, a set of rows with the column ``__value``, holds the key.

    The table is streamed against the batch's distinct keys; only what both hold is joined back.
    """
    keyed = rows.withColumn("__at", key)
    wanted = distinct_keys(keyed, "__at").withColumnRenamed("__at", "__value")
    held = distinct_keys(table.join(wanted, "__value", "left_semi"), "__value")
    held = held.select("__value", F.lit(True).alias(name))
    joined = left_join_unique(keyed, materialize(held), "__at", "__value")
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).drop("__at")


def _key_text(columns: list[str]) -> Column:
    """The key as one text, null where one of its columns is."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(whole, F.to_json(F.struct(*columns)))


def check_batch(rows: DataFrame, rules: Constraints, existing: DataFrame | None = None) -> DataFrame:
    """The rows with ``refused``: what each breaks, comma-joined, or null for those that may be written.

    ``null:c`` and ``domain:c`` are read off the row; ``orphan:c`` asks the referenced table. Of the rows
    without these, ``unique:k`` refuses those whose key ``existing`` holds and all but the first of a
    key in the batch, so a broken row never shuts out a good one. Tables are streamed against the
    batch's keys and never shuffled whole; a key that holds much of the batch is counted by partial
    aggregates and joined back spread.
    """
    broken = [F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in rules.not_null]
    broken += [F.when(~F.col(c).isin(allowed), F.lit(f"domain:{c}")) for c, allowed in rules.domains.items()]
    checked = rows
    for i, (column, (parent, parent_key)) in enumerate(rules.references.items()):
        checked = _with_held(checked, F.col(column), parent.select(F.col(parent_key).alias("__value")), f"__held_{i}")
        broken.append(F.when(F.col(column).isNotNull() & ~F.col(f"__held_{i}"), F.lit(f"orphan:{column}")))
    refused = F.nullif(F.concat_ws(",", *broken), F.lit("")) if broken else F.lit(None).cast("string")
    checked = checked.withColumn("refused", refused).select(*rows.columns, "refused")
    if not rules.unique:
        return checked
    # written, so that a row keeps its number
    good = F.when(F.col("refused").isNull(), _key_text(rules.unique))
    numbered = materialize(checked.withColumns({"__key": good, "__row": F.monotonically_increasing_id()}))
    taken = F.lit(False)
    if existing is not None:
        stored = existing.select(_key_text(rules.unique).alias("__value"))
        numbered = _with_held(numbered, F.col("__key"), stored, "__stored")
        taken = F.col("__stored")
    place = F.struct(*rules.order, "__row")
    firsts = numbered.filter("__key IS NOT NULL").groupBy("__key").agg(F.min(place).alias("__place"), F.count("*").alias("__n"))
    firsts = firsts.filter("__n > 1").select(F.col("__key").alias("__first_key"), F.col("__place.__row").alias("__first"), "__n")
    joined = left_join_unique(numbered, firsts, "__key", "__first_key", "__n")
    late = taken | F.coalesce(F.col("__first") != F.col("__row"), F.lit(False))
    name = F.lit("unique:" + "+".join(rules.unique))
    return joined.withColumn("refused", F.when(late, name).otherwise(F.col("refused"))).select(*rows.columns, "refused")
