"""The language of a text by its character trigrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.latest import top_n_per_key
from feedloom.operators.skew import left_join_unique
from feedloom.session import materialize

# Trigrams of a language's profile, and texts that a language needs to be learned. With them the
# model has at most PROFILE rows per language, however large the corpus is.
PROFILE = 1000
MIN_TEXTS = 20
# Weights are logarithms in thousandths, as whole numbers: their sums do not depend on the order.
SCALE = 1000


@dataclass(frozen=True)
class LanguageModel:
    """``grams`` has a trigram and ``w0``, ``w1``, … per language of ``languages``, which are sorted."""

    grams: DataFrame
    languages: list[str]


def trigrams(text: Column | str) -> Column:
    """Trigrams of the letters of a text in lower case, with one space around words; none without a letter."""
    letters = F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " "))
    padded = F.when(letters != "", F.concat(F.lit(" "), letters, F.lit(" ")))
    return F.regexp_extract_all(padded, F.lit("(?=(...))"), F.lit(1))


def train_languages(
    labelled: DataFrame, text: str = "text", language: str = "lang", profile: int = PROFILE, min_texts: int = MIN_TEXTS
) -> LanguageModel:
    """Fit on rows with a text and a language, each distinct text of a language once.

    The most frequent trigrams of every language make the profile, ties by code point. A weight is
    ``floor(1000 * ln((count + 1) / (sum of counts + rows)))`` over the trigrams of the profile.
    Rows without a text or language are left out; without any language the model knows none.
    Copies meet by the hash of their text; what moves beyond that are counts, added per task.
    """
    known = labelled.filter(F.col(text).isNotNull() & F.col(language).isNotNull())
    once = known.select(F.col(language).alias("language"), F.col(text).alias("text")).dropDuplicates()
    seen = once.select("language", F.explode(trigrams("text")).alias("gram"))
    texts = once.groupBy("language").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts)
    counts = materialize(seen.groupBy("language", "gram").agg(F.count("*").alias("n")))
    counts = counts.join(F.broadcast(texts.select("language")), "language", "left_semi")
    languages = sorted(row["language"] for row in texts.select("language").collect())
    top = top_n_per_key(counts, ["language"], [F.col("n").desc(), F.col("gram")], profile, "__rank")
    # one row per trigram of a profile, at most ``profile`` per language
    chosen = top.select("gram").distinct()
    held = [F.coalesce(F.sum(F.when(F.col("language") == l, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, l in enumerate(languages)]
    if not languages:
        return LanguageModel(chosen, [])
    table = materialize(counts.join(F.broadcast(chosen), "gram", "left_semi").groupBy("gram").agg(*held))
    totals = table.agg(F.count("*").alias("rows"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]).first()
    if not totals["rows"]:
        return LanguageModel(chosen, [])

    def weight(i: int) -> Column:
        share = (F.col(f"n{i}") + 1) / F.lit(float(totals[f"n{i}"] + totals["rows"]))
        return F.floor(SCALE * F.log(share)).alias(f"w{i}")

    return LanguageModel(materialize(table.select("gram", *[weight(i) for i in range(len(languages))])), languages)


def languages_of(rows: DataFrame, model: LanguageModel, row_id: str = "id", text: str = "text") -> DataFrame:
    """(row_id, language): the language whose weights over the text's trigrams sum highest, ties by name.

    ``row_id`` is unique. Texts without a trigram of the profile are left out. The model, of bounded
    size, goes to the texts; of a document one row of sums per task moves.
    """
    if not model.languages:
        return rows.select(row_id, F.lit(None).cast("string").alias("language")).limit(0)
    seen = rows.select(F.col(row_id).alias("__id"), F.explode(trigrams(text)).alias("gram"))
    joined = seen.join(F.broadcast(model.grams), "gram")
    sums = joined.groupBy("__id").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(model.languages))])
    best = F.greatest(*[F.col(f"w{i}") for i in range(len(model.languages))]) if len(model.languages) > 1 else F.col("w0")
    named = F.coalesce(*[F.when(F.col(f"w{i}") == best, F.lit(l)) for i, l in enumerate(model.languages)])
    return sums.select(F.col("__id").alias(row_id), named.alias("language"))


def with_language(rows: DataFrame, model: LanguageModel, row_id: str = "id", text: str = "text") -> DataFrame:
    """Rows with ``language``, in place of a column of that name; null where the text shows none."""
    found = languages_of(rows, model, row_id, text).withColumnRenamed(row_id, "__language_id")
    return left_join_unique(rows.drop("language"), materialize(found), row_id, "__language_id")
