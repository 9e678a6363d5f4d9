"""Filter audit: what each filter removes alone, after others, and on average over all orders."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import left_join_unique
from feedloom.operators.stage import compute_once
from feedloom.session import materialize

LETTERS = "ABCDE"
N = len(LETTERS)
FULL = (1 << N) - 1
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
COUNTS = ["n", "good", "toxic"]


def _of(bits: int) -> list[int]:
    return [k for k in range(N) if bits >> k & 1]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n_words, n_kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = [
        n_words < MIN_WORDS,
        100 * n_kinds < 50 * n_words,
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def failures(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, failed): one row per document, with a bit for each filter it fails.

    The texts are read once; what goes on is narrow. Of equal texts, known by their SHA-256, a
    document fails E if a smaller id has the text: the smallest id per text is a map-side combined
    aggregate, joined back with hot texts spread.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        whole.alias("text"),
    )
    found = {"failed": text_failures(F.col("text")), "text_hash": F.sha2("text", 256)}
    rows = materialize(compute_once(rows, found).select("doc_id", "part", "failed", "text_hash"))
    first = (
        rows.groupBy(F.col("text_hash").alias("__hash"))
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("__n"))
        .filter("__n > 1")
    )
    joined = left_join_unique(rows, first, "text_hash", "__hash", "__n")
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    failed = F.col("failed") + F.when(copied, 1 << LETTERS.index("E")).otherwise(0)
    return joined.select("doc_id", "part", failed.alias("failed"))


def cells(rows: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """(part, failed, n, good, toxic): at most 32 rows per part."""
    known = (
        labels.select(
            F.col(doc_id).cast("long").alias("__id"),
            (F.col("quality") == 1).cast("int").alias("good"),
            (F.col("toxic") == 1).cast("int").alias("toxic"),
        )
        .filter("__id IS NOT NULL")
        .groupBy("__id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    labelled = left_join_unique(materialize(rows), known, "doc_id", "__id")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return labelled.groupBy("part", "failed").agg(F.count("*").alias("n"), *sums)


def removal_games(counted: DataFrame) -> DataFrame:
    """One row per part: for each coalition of filters what it removes, as arrays by the coalition's bits.

    ``n``, ``good`` and ``toxic`` hold 32 numbers each; ``total`` counts all documents of the part.
    """

    coalition = F.explode(F.sequence(F.lit(0), F.lit(FULL)))
    spread = counted.withColumn("coalition", coalition)
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    removed = spread.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in COUNTS]
    )
    games = F.array_sort(F.collect_list(F.struct("coalition", *COUNTS))).alias("game")
    return removed.groupBy("part").agg(F.max("total").alias("total"), games).select(
        "part", "total", *[F.col(f"game.{c}").alias(c) for c in COUNTS]
    )


def potentials(game: Column) -> Column:
    """The Hart-Mas-Colell potential of each coalition, times the factorial of its size.

    ``P(S) = (v(S) + sum of P(S without i)) / |S|`` for the members i of S; times ``|S|!`` all numbers
    are whole. A coalition's bits are larger than those of its parts, so one pass in their order does.
    """
    plans = F.array(
        *[
            F.struct(
                F.lit(s).alias("s"),
                F.lit(factorial(len(_of(s)) - 1)).cast("long").alias("weight"),
                F.array(*[F.lit(s - (1 << k)) for k in _of(s)]).alias("parts"),
            )
            for s in range(1, FULL + 1)
        ]
    )

    def next_one(done: Column, plan: Column) -> Column:
        below = F.aggregate(plan["parts"], F.lit(0).cast("long"), lambda total, p: total + F.get(done, p))
        return F.concat(done, F.array(plan["weight"] * F.get(game, plan["s"]) + below))

    return F.aggregate(plans, F.array(F.lit(0).cast("long")), next_one)


def filter_audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Five filters: A under 200 words; B fewer than half of the words distinct; C capitals above 3 % of
    the characters; D a character of ``#$%&*|``; E the text of a smaller id. For each part, each of
    their 120 orders and each step: what is kept after it, removed by it, fails it but was removed
    before, fails it alone, and how many of the removed are labelled good or toxic. ``shapley`` is the
    sum over all orders of what the filter removes, 120 times its Shapley value.

    A part's documents are counted by the set of filters they fail. The removal game gives each
    coalition what it removes; a step's numbers are differences of coalitions. The filter's Shapley
    value is the potential of all five minus that of the others.

    Null and empty texts are the same, empty text, and fail A. A null part is the part ''. A row
    without an id has no label, never fails E, and makes no other row fail it; rows that share the
    smallest id of a text do not fail E either. Repeated rows count as often as they come. Labels of
    one id are combined by the larger, null labels count as 0. Texts of any length are read whole.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    games = removal_games(cells(failures(docs, doc_id, text, part), labels, doc_id))
    games = materialize(games.withColumn("potential", potentials(F.col("n"))))
    orders = F.explode(F.lit(["".join(p) for p in permutations(LETTERS)]))
    steps = games.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(N))))

    def bits(letters: Column) -> Column:
        return sum((F.when(letters.contains(x), 1 << k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))

    steps = steps.withColumns(
        {
            "before": bits(F.expr("substring(filter_order, 1, step - 1)")),
            "own": bits(F.expr("substring(filter_order, step, 1)")),
        }
    )
    before, own = F.col("before"), F.col("own")

    def gone(count: str) -> Column:
        return F.get(count, before + own) - F.get(count, before)

    others = F.get("n", FULL - own)
    shapley = F.get("potential", F.lit(FULL)) - N * F.get("potential", FULL - own)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.get("n", before + own)).alias("kept"),
        gone("n").alias("removed"),
        (F.get("n", own) - gone("n")).alias("redundant"),
        (F.get("n", F.lit(FULL)) - others).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )
