"""Staging of costly columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    As generator output they are not copied into the filters and projections above, which would
    parse or scan the same text again for every use.
    """
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(struct)))
