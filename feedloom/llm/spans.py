"""Positions of regular-expression matches as columns, without Python in the tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.stage import compute_once


@dataclass(frozen=True)
class Kind:
    """What to find: a pattern, and which of its matches count.

    ``keep`` gets the whole match and the text of ``group``. ``needs`` is a text without which
    there is no match, checked first because that is cheap.
    """

    name: str
    pattern: str
    keep: Callable[[Column, Column], Column] | None = None
    group: int = 0
    needs: str | None = None


def _spans(matches: Column, groups: Column, gaps: Column, kind: Kind, index: int, context: bool) -> Column:
    """Start, kind and end of the matches that count; with ``context`` also the text before, and the match."""
    keep = kind.keep or (lambda match, group: F.lit(True))
    pairs = F.zip_with(matches, groups, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    # there is one gap more than there are matches: the text after the last
    steps = F.filter(
        F.zip_with(
            pairs,
            gaps,
            lambda x, gap: F.struct(
                F.length(gap).alias("gap"),
                F.length(x["m"]).alias("n"),
                F.coalesce(keep(x["m"], x["g"]), F.lit(False)).alias("ok"),
                *([before(gap).alias("before"), x["m"].alias("value")] if context else []),
            ),
        ),
        lambda x: x["n"].isNotNull(),
    )
    fields = "start:int,kind:int,end:int" + (",before:string,value:string" if context else "")
    none = F.array().cast(f"array<struct<{fields}>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        extra = [x["before"].alias("before"), x["value"].alias("value")] if context else []
        span = F.struct(start.alias("start"), F.lit(index).alias("kind"), (start + x["n"]).alias("end"), *extra)
        return F.struct(
            (start + x["n"]).alias("at"),
            F.when(x["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(F.size(matches) > 0, found).otherwise(none)


def before(gap: Column) -> Column:
    """Up to two words at the end of a text, lower-cased and without punctuation around them."""
    tail = F.regexp_extract(
        F.substring(gap, -64, 64), r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1
    )
    words = F.transform(
        F.split(F.lower(tail), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")
    )
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def with_spans(
    rows: DataFrame,
    text: str,
    kinds: list[Kind],
    first: int = 0,
    wanted: Callable[[Kind], Column] | None = None,
    context: bool = False,
) -> DataFrame:
    """Adds an array of spans per kind, ``spans_<name>``, in code points, the end exclusive.

    Matches are the leftmost that do not overlap, per kind; one that ``keep`` refuses is dropped
    after it has used up its text. Every pattern runs once for the matches and, where there are
    any, once more for the gaps between them, from which the positions follow.
    """
    found, gaps = {}, {}
    for kind in kinds:
        gate = F.lit(True) if kind.needs is None else F.contains(F.col(text), F.lit(kind.needs))
        if wanted is not None:
            gate = wanted(kind) & gate
        regex = F.lit(kind.pattern)
        found[f"__m_{kind.name}"] = F.when(gate, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(
            F.array().cast("array<string>")
        )
    staged = compute_once(rows, found)
    for kind in kinds:
        matches, regex = F.col(f"__m_{kind.name}"), F.lit(kind.pattern)
        has = F.size(matches) > 0
        gaps[f"__p_{kind.name}"] = F.when(has, F.split(F.col(text), kind.pattern, -1))
        if kind.group:
            gaps[f"__g_{kind.name}"] = F.when(has, F.regexp_extract_all(text, regex, F.lit(kind.group)))
    staged = compute_once(staged, gaps)
    spans = {}
    for i, kind in enumerate(kinds):
        matches = F.col(f"__m_{kind.name}")
        groups = F.col(f"__g_{kind.name}") if kind.group else matches
        spans[f"spans_{kind.name}"] = _spans(matches, groups, F.col(f"__p_{kind.name}"), kind, first + i, context)
    return compute_once(staged, spans).drop(*found, *gaps)


def written(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    named = F.array(*map(F.lit, names))
    texts = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(texts, ",")
