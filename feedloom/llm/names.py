"""Names for helper columns beside a user's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer than every column of the table, so that none of them clashes."""
    taken = max(map(len, docs.columns), default=0)
    return [f"__{name}_".ljust(taken + 1, "_") for name in names]
