"""Text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, control separators included: body of a Java character class under (?U).
SPACE_CLASS = r"\s\x1c-\x1f"
_EDGE_SPACE = rf"(?U)\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"


def space_runs(space_class: str = SPACE_CLASS) -> str:
    """Pattern of the runs that need replacing: all but one plain space."""
    return rf"(?U)[{space_class}](?:(?<! )[{space_class}]*+|[{space_class}]++)"


_SPACE_RUNS = space_runs()


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def strip_text(value: Column | str) -> Column:
    """Whitespace removed at both ends, inner whitespace untouched."""
    return F.regexp_replace(col_of(value), _EDGE_SPACE, "")


def normalize_text(value: Column | str) -> Column:
    """Whitespace runs become one space, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col_of(value), F.lit("")), _SPACE_RUNS, " "))


def sha256_text(value: Column | str) -> Column:
    return F.sha2(col_of(value), 256)


def truncate_normalized(value: Column, limit: int) -> Column:
    """Cut text that is already whitespace-normalized to ``limit`` characters, with an ellipsis."""
    keep = max(0, limit - 3)
    cut = F.concat(F.rtrim(F.substring(value, 1, keep)), F.lit("..."))
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def truncate_text(value: Column | str, limit: int) -> Column:
    return truncate_normalized(normalize_text(value), limit)


def slugify(value: Column | str, fallback: str = "item") -> Column:
    """Lower-case slug of ASCII letters, digits and CJK ideographs, at most 80 characters."""
    dashed = F.regexp_replace(col_of(value), r"[^a-zA-Z0-9\u4e00-\u9fff]+", "-")
    slug = F.substring(F.lower(F.btrim(dashed, F.lit("-"))), 1, 80)
    return F.coalesce(blank_to_null(slug), F.lit(fallback))


def content_hash(title: Column | str, url: Column | str, content: Column | str) -> Column:
    """sha256 over the three parts, one per line."""
    parts = [F.coalesce(col_of(c), F.lit("")) for c in (title, url, content)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def split_list(value: Column | str) -> Column:
    """Comma list to an array of trimmed, non-blank entries."""
    parts = F.transform(F.split(col_of(value), ","), strip_text)
    return F.filter(parts, lambda part: part != "")
