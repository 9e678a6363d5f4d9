"""Quality rules: counts per document, and lines that many documents of a host share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.names import free_names
from feedloom.llm.simhash import text_versions
from feedloom.operators.skew import left_join_unique
from feedloom.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Normalised lines: A-Z lower-cased, digits as 0, white space collapsed.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
MIN_WORDS = 50
# A line is boilerplate of its host above this many documents; near copies of one text are one.
MAX_DOCS = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ROW = (
    "doc_id long, host string, text_hash string, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", line_hash array<long>, line_words array<int>"
)


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` words that occurs twice or more in the text."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    n = len(words) - size + 1
    windows = ids[:n]
    for k in range(1, size):
        # numbered anew at each step, so that products stay small
        windows = np.unique(windows * len(numbers) + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= again
    return int(covered.sum())


def line_key(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(b" ".join(line.translate(FOLD).split())).digest()[:8], "big")


def measure(text: str) -> tuple:
    """The base counts, then hash and words of each line with a word."""
    data = text.encode()
    words = data.split()
    lines = [(line, len(own)) for line in data.split(b"\n") if (own := line.split())]
    known: dict[bytes, int] = {line: line_key(line) for line, _ in dict.fromkeys(lines)}
    keys = [known[line] for line, _ in lines]
    return (
        hashlib.md5(data).hexdigest(),
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(known),
        repeat_words(words),
        [signed(k) for k in keys],
        [n for _, n in lines],
    )


def signed(key: int) -> int:
    """Order-preserving."""
    return key - (1 << 63)


def measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["doc_id", "host", "text_hash", *COUNTS, "line_hash", "line_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*[measure(t.as_py() or "") for t in batch.column(2)], strict=True)
            arrays = [pa.array(v, k) for v, k in zip(found, kinds, strict=True)]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    narrow = docs.select(F.col(doc_id).cast("long"), F.col(host).cast("string"), F.col(text).cast("string"))
    return narrow.mapInArrow(run, ROW)


def boilerplate_lines(rows: DataFrame, versions: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line): lines in more than ``max_docs`` distinct documents of a host.

    Near copies of one text, which ``versions`` (text_hash, version) tells, are one document. Copies
    on a host meet in one row before their lines are listed, and a line's versions are counted by
    partial aggregates.
    """
    texts = rows.groupBy("host", "text_hash").agg(F.any_value("line_hash").alias("line_hash"))
    named = left_join_unique(materialize(texts), versions.withColumnRenamed("text_hash", "__text"), "text_hash", "__text")
    lines = named.select("host", "version", F.explode(F.array_distinct("line_hash")).alias("line")).distinct()
    return lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("host", "line")


def _removed(docs: DataFrame, doc_id: str, text: str, host: str) -> tuple[DataFrame, DataFrame]:
    """The measured rows, and per document the hashes of its boilerplate lines."""
    rows = materialize(measured(docs, doc_id, text, host))
    versions = materialize(text_versions(docs, doc_id, text))
    shared = materialize(
        boilerplate_lines(rows, versions).select(F.col("host").alias("__host"), F.col("line").alias("__line"))
    )
    lines = rows.select("host", "doc_id", "text_hash", F.explode(F.array_distinct("line_hash")).alias("line"))
    hit = lines.join(shared, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line")))
    cut = hit.groupBy("host", "doc_id", "text_hash").agg(F.collect_set("line").alias("__cut"))
    return rows, materialize(cut.select(*[F.col(c).alias(f"__{c}") for c in ("host", "doc_id", "text_hash")], "__cut"))


def _same(doc_id: Column, host: Column, text_hash: Column) -> Column:
    return (
        (text_hash == F.col("__text_hash"))
        & doc_id.eqNullSafe(F.col("__doc_id"))
        & host.eqNullSafe(F.col("__host"))
    )


def _judged(rows: DataFrame, cut: DataFrame) -> DataFrame:
    joined = rows.join(cut, _same(F.col("doc_id"), F.col("host"), F.col("text_hash")), "left")
    lost = F.aggregate(
        F.arrays_zip("line_hash", "line_words"),
        F.lit(0).cast("long"),
        lambda total, x: total + F.when(F.array_contains("__cut", x["line_hash"]), x["line_words"]).otherwise(0),
    )
    lost = F.when(F.col("__cut").isNull(), F.lit(0).cast("long")).otherwise(lost)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("n_lost_words", lost).withColumn("base_failed", failed)


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words).

    One row per input row. Lines are normalised and hashed; a line that more than ``MAX_DOCS``
    distinct documents of a host share is removed from all of them. Documents that the SimHash
    operator groups, as near copies of one text, count as one. ``kept`` is false if a base rule fails
    or if that removes more than half of the words.

    Counts are map-side combined, so a line of any frequency is spread; no list of documents per
    line is ever gathered.

    Null and empty texts have no words and fail the base rules. Null hosts are one host. Repeated rows
    are judged alike and count as one document. Texts are read whole, however long. Other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    rows, cut = _removed(docs, doc_id, text, host)
    kept = ~F.col("base_failed") & (2 * F.col("n_lost_words") <= F.col("n_words"))
    return _judged(rows, cut).select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "n_lost_words")


def without_lines(text: str, cut: set[int]) -> str:
    """The text without the lines whose hash is in ``cut``; lines without a word stay."""
    lines = [(line, line.encode()) for line in text.split("\n")]
    return "\n".join(line for line, data in lines if not data.split() or signed(line_key(data)) not in cut)


def clean_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", length: str | None = None
) -> DataFrame:
    """The documents that ``quality_rules`` keeps, without their boilerplate lines; same columns.

    ``length`` names a column to hold the new number of characters. Texts move once, by id and hash.
    Null and empty texts are not kept, repeated rows come as often as before, an empty table stays empty.
    Null ids and hosts are like any other; columns of any name keep their values.
    """
    rows, cut = _removed(docs, doc_id, text, host)
    good = _judged(rows, cut).filter(~F.col("base_failed") & (2 * F.col("n_lost_words") <= F.col("n_words")))
    key = ["doc_id", "host", "text_hash"]
    own_id, own_host, own_hash, lines = free_names(docs, *key, "cut")
    named = dict(zip(key, (own_id, own_host, own_hash), strict=True))
    good = good.select(*[F.col(c).alias(n) for c, n in named.items()], F.col("__cut").alias(lines))
    good = good.dropDuplicates([*named.values()])
    text_hash = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    same = (
        (text_hash == F.col(own_hash))
        & F.col(doc_id).cast("long").eqNullSafe(F.col(own_id))
        & F.col(host).cast("string").eqNullSafe(F.col(own_host))
    )
    marked = docs.join(materialize(good), same)

    @F.pandas_udf("string")
    def stripped(texts, cuts):
        return texts.combine(cuts, lambda t, c: t if c is None else without_lines(t, set(c)))

    out = marked.withColumn(text, stripped(F.col(text).cast("string"), F.col(lines)))
    if length:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
