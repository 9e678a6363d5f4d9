"""Personal data: rule-based entities as seeds, contextual patterns that find further identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.names import free_names
from feedloom.llm.spans import Kind, with_spans, written
from feedloom.operators.stage import compute_once
from feedloom.session import materialize


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check digit of a card number is right."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(match: Column, _: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _phone(match: Column, _: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)




def _ip(match: Column, _: Column) -> Column:
    return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$")


# A match can only start where its run of characters starts, or where the last match ended; saying
# so, and possessive repeats, keep long runs linear without changing what is found.
EMAIL_RUN = "A-Za-z0-9._%+-"
BASE = [
    Kind(
        "email",
        rf"(?:(?<![{EMAIL_RUN}])|\G)[{EMAIL_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        needs="@",
    ),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", _ip, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, needs="+"),
]
# What an unseen identifier can be: a word with a digit or an at sign.
CANDIDATE = Kind(
    "candidate", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
)
NAMES = [k.name for k in BASE]
# A pattern is trusted from this many distinct seeds, and this share of all it stands before.
MIN_SEEDS, MIN_CONFIDENCE = 3, 0.5
# An instance is accepted from this score.
MIN_SCORE = 0.75
# Rounds of the plain version that the tests compare with; discovery itself ends by itself.
MAX_ROUNDS = 5


def entities(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, base, candidates): spans with the words before them, one row per input row.

    A candidate that overlaps a base span is left out.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    found = with_spans(rows, "text", BASE, context=True)
    found = with_spans(found, "text", [CANDIDATE], first=-1, context=True)
    both = compute_once(
        found.select(
            document_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "spans_candidate",
            F.concat(*[F.col(f"spans_{name}") for name in NAMES]).alias("base"),
        ),
        {
            "candidates": F.filter(
                "spans_candidate",
                lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
            )
        },
    )
    return both.drop("spans_candidate")


def document_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))


def _instance(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"^\p{Punct}+|\p{Punct}+$", "")


def mentions(found: DataFrame) -> DataFrame:
    """(key, pattern, instance, kind, start, end): spans with a context; kind -1 marks a candidate."""
    spans = found.select("key", F.explode(F.concat("base", "candidates")).alias("s"))
    return spans.select(
        "key", F.col("s.before").alias("pattern"), _instance(F.col("s.value")).alias("instance"),
        F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
    )


def trusted_patterns(graph: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, confidence): the share of a pattern's instances that are known to be of a kind."""
    tagged = graph.join(known, "instance", "left")
    seeds = tagged.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds"))
    every = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    return (
        seeds.filter(F.col("n_seeds") >= MIN_SEEDS)
        .join(every, "pattern")
        .select("pattern", "kind", (F.col("n_seeds") / F.col("n")).alias("confidence"))
        .filter(F.col("confidence") >= MIN_CONFIDENCE)
    )


def accepted_instances(graph: DataFrame, patterns: DataFrame, known: DataFrame) -> DataFrame:
    """(instance, kind): unknown instances whose patterns together make a kind likely (noisy or)."""
    doubt = F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))
    scored = (
        graph.join(known, "instance", "left_anti")
        .join(patterns, "pattern")
        .groupBy("instance", "kind")
        .agg((1 - F.exp(F.sum(doubt))).alias("score"))
        .filter(F.col("score") >= MIN_SCORE)
    )
    best = scored.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("best"))
    return best.select("instance", (-F.col("best.col2")).alias("kind"))


def discovered(found: DataFrame) -> DataFrame:
    """(key, start, end, kind): candidates that the bootstrapped patterns accept.

    Seeds induce patterns, the two words before them. Round by round, patterns are scored by their
    known instances and instances by their patterns, both over the distinct edges of the graph; the
    accepted instances are seeds of the next round, until a round accepts none; known instances only
    grow, so that comes. Each round's list is written, so it is computed once and outlives executors. The graph has one edge per pattern and instance, however frequent.
    """
    said = materialize(mentions(found))
    graph = materialize(said.filter("pattern <> '' AND instance <> ''").select("pattern", "instance").distinct())
    seeds = said.filter("kind >= 0 AND instance <> ''").groupBy("instance").agg(F.min("kind").alias("kind"))
    known = materialize(seeds)
    fresh = known.limit(0)
    while True:
        every = known.unionByName(fresh)
        new = materialize(accepted_instances(graph, trusted_patterns(graph, every), every))
        if new.isEmpty():
            break
        fresh = materialize(fresh.unionByName(new))
    fresh = fresh.select(F.col("instance").alias("__instance"), F.col("kind").alias("__kind"))
    return (
        said.filter("kind < 0")
        .join(fresh, F.col("instance") == F.col("__instance"))
        .select("key", "start", "end", (F.col("__kind") + len(NAMES)).alias("kind"))
    )


def all_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, base, spans): sorted spans (start, kind, end); kinds above the base are discovered."""
    found = materialize(entities(docs, doc_id, text))
    span = F.struct("start", F.col("kind").cast("int").alias("kind"), "end")
    more = discovered(found).groupBy("key").agg(F.collect_set(span).alias("more"))
    more = materialize(more.withColumnRenamed("key", "__key"))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.join(more, F.col("key") == F.col("__key"), "left").select(
        "key", "doc_id",
        F.sort_array(plain).alias("base"),
        F.sort_array(F.concat(plain, F.coalesce("more", none))).alias("spans"),
    )


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    Spans are ``kind:start:end`` in code points, the end exclusive, sorted by start and kind. The
    rules make the digest; ``found_<kind>`` spans are discovered by context.

    A null text is empty; null ids are kept; repeated rows are returned as often as they came. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    names = [*NAMES, *[f"found_{name}" for name in NAMES]]

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return all_spans(docs, doc_id, text).select(
        "doc_id",
        *[number(i).alias(f"n_{name}") for i, name in enumerate(NAMES)],
        F.sha2(written(F.col("base"), names), 256).alias("base_sha256"),
        written(F.col("spans"), names).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the name of the first."""
    labels = F.array(*[F.lit(f"[{name.upper()}]") for name in NAMES * 2])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        apart = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], kept, F.get(labels, s["kind"]))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    )


def redact_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None
) -> DataFrame:
    """All documents with personal data replaced by its kind; same columns, texts move once.

    ``length`` names a column to hold the new number of characters. Null texts stay null and empty
    ones empty; null ids and repeated rows are kept, each row redacted alike. Texts are read whole,
    however long. Columns of any name keep their values; an empty table stays empty.
    """
    own, marks, result = free_names(docs, "key", "spans", "clean")
    spans = all_spans(docs, doc_id, text).filter(F.size("spans") > 0)
    spans = materialize(spans.select(F.col("key").alias(own), F.col("spans").alias(marks)).dropDuplicates([own]))
    key = document_key(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    joined = docs.join(spans, key == F.col(own), "left")
    clean = F.when(F.col(marks).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(marks)))
    out = compute_once(joined, {result: clean}).withColumn(text, F.col(result))
    if length:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
