"""Secret scans: Boolean trigram queries from the patterns, postings, verification of candidates."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.spans import Kind, with_spans, written
from feedloom.operators.stage import compute_once
from feedloom.session import materialize

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
BASE = [
    Kind(
        "assign",
        f"({KEYWORD})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        keep=lambda match, value: F.length(value) >= 6,
        group=2,
    ),
    # a shorter run of the same characters is no match of the rule, and holds none
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Kind("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Kind("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Kind("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Kind("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
# More alternatives than this end a run of exact strings.
MOST_STRINGS = 32


def _strings(op, value) -> set[str] | None:
    """All texts an element of a pattern can match, lower-cased, or None if they are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, item in value:
            if str(kind) == "LITERAL":
                found.add(chr(item).lower())
            elif str(kind) == "RANGE" and item[1] - item[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(item[0], item[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_STRINGS else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(branch) for branch in value[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and value[:2] == (0, 1):
        once = _sequence_strings(value[2])
        return None if once is None else {"", *once}
    return None


def _sequence_strings(sequence) -> set[str] | None:
    run = {""}
    for op, value in sequence:
        own = _strings(op, value)
        if own is None or len(run) * len(own) > MOST_STRINGS:
            return None
        run = {a + b for a, b in product(run, own)}
    return run


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND over groups, OR over the clauses of a group, AND over the trigrams of a clause.

    Every match of the pattern, lower-cased, satisfies the query. No group: no trigram is mandatory.
    """
    groups: list[list[list[str]]] = []

    def close(run: set[str]) -> None:
        if all(len(s) >= 3 for s in run):
            groups.append([sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(run)])

    def walk(sequence) -> None:
        run = {""}
        for op, value in sequence:
            own = _strings(op, value)
            # an optional element only multiplies the clauses
            if own is not None and "" not in own and len(run) * len(own) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, own)}
                continue
            close(run)
            run = own if own is not None and "" not in own else {""}
            if own is None and str(op) == "SUBPATTERN":
                walk(value[-1])
            elif own is None and "REPEAT" in str(op) and value[0] >= 1:
                walk(value[2])
        close(run)

    walk(re._parser.parse(pattern))
    return groups


def _clauses(spark: SparkSession, kinds: list[Kind]) -> tuple[DataFrame, list[str], list[int]]:
    """The clause table, its trigrams, and the rules without a mandatory trigram."""
    rows, full = [], []
    for rule, kind in enumerate(kinds):
        groups = trigram_query(kind.pattern)
        if not groups:
            full.append(rule)
        for g, clauses in enumerate(groups):
            for c, trigrams in enumerate(clauses):
                rows += [(rule, len(groups), g, c, len(trigrams), t) for t in trigrams]
    kind = "rule int, n_groups int, grp int, clause int, n_trigrams int, trigram string"
    return spark.createDataFrame(rows, kind), sorted({r[-1] for r in rows}), full


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): the inverted index over the trigrams that the rules ask for."""
    lowered = compute_once(rows.select("key", "text"), {"low": F.lower("text")})
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return lowered.select("key", F.explode(held).alias("trigram"))


def candidates(rows: DataFrame, kinds: list[Kind]) -> tuple[DataFrame, list[int]]:
    """(key, rules): documents whose postings satisfy a rule's query; and the rules that scan fully."""
    clauses, trigrams, full = _clauses(rows.sparkSession, kinds)
    # the clause table is as large as the rules, whatever the documents
    hits = postings(rows, trigrams).join(F.broadcast(clauses), "trigram")
    met = (
        hits.groupBy("key", "rule", "n_groups", "grp", "clause", "n_trigrams")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter(F.col("n") == F.col("n_trigrams"))
    )
    passed = (
        met.groupBy("key", "rule", "n_groups")
        .agg(F.count_distinct("grp").alias("n"))
        .filter(F.col("n") == F.col("n_groups"))
    )
    return passed.groupBy("key").agg(F.collect_set("rule").alias("rules")), full


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per input row.

    Spans are ``kind:start:end`` in code points, the end exclusive, sorted by start and kind. The
    patterns of ``BASE`` make the digest; those of ``MORE`` are added to ``spans``.

    Each pattern becomes a Boolean query over trigrams of the lower-cased text; the postings of the
    trigrams are intersected per document, and a pattern runs over the documents that satisfy its
    query. Patterns without a mandatory trigram run over all documents.

    A null text is empty; null ids are kept; repeated rows are returned as often as they came. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    kinds = BASE + MORE
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    # two documents with one key would only share their candidate rules, which are verified
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    asked, full = candidates(rows, kinds)
    asked = materialize(asked.withColumnRenamed("key", "__key"))
    verified = rows.join(asked, F.col("key") == F.col("__key"), "left").drop("key", "__key")
    index = {kind.name: i for i, kind in enumerate(kinds)}

    def wanted(kind: Kind):
        if index[kind.name] in full:
            return F.lit(True)
        return F.coalesce(F.array_contains("rules", index[kind.name]), F.lit(False))

    found = with_spans(verified, "text", kinds, wanted=wanted).drop("text", "rules")
    names = [kind.name for kind in kinds]
    base = F.sort_array(F.concat(*[F.col(f"spans_{kind.name}") for kind in BASE]))
    every = F.sort_array(F.concat(*[F.col(f"spans_{name}") for name in names]))
    return found.select(
        "doc_id",
        *[F.size(f"spans_{kind.name}").cast("long").alias(f"n_{kind.name}") for kind in BASE],
        F.sha2(written(base, names), 256).alias("base_sha256"),
        written(every, names).alias("spans"),
    )
