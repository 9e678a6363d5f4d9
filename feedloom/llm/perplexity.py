"""Quality by perplexity: interpolated modified Kneser-Ney over characters, counted on trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import left_join_unique
from feedloom.session import materialize

# Four characters of 16 bits make the key of an n-gram; characters beyond share one code.
ORDER, BITS, CODES = 4, 16, 1 << 16
START, END = 2, 3
TOGETHER = 256
# Characters that are turned into n-grams at once.
PIECE = 1 << 16
# One in so many labelled documents is not counted but sets the thresholds.
HELD = 5
QUANTILES, ACCURACY = (0.999, 0.995, 0.99, 0.985, 0.98), 100_000
# The Bloom filter of trusted ids: bits per id, hashes, and the bits of the largest filter (16 MB).
BLOOM_BITS, BLOOM_HASHES, BLOOM_MOST = 12, 4, 1 << 27
# The table of log probabilities is broadcast up to this many rows of 16 bytes; beyond, it is joined.
BROADCAST_ROWS = 4_000_000
# Characters of a group of documents that is joined to its n-grams at once.
GROUP_CHARS = 32 << 20


def grams(text: str, start: int = 0, end: int | None = None) -> np.ndarray:
    """Keys of all n-grams that end in a part of a text; the last part has one more, for the text's end."""
    end = len(text) if end is None else min(end, len(text))
    codes = np.frombuffer(text[max(start - ORDER + 1, 0) : end].encode("utf-32-le"), np.uint32)
    pad = max(ORDER - 1 - start, 0)
    codes = np.concatenate([[START] * pad, np.minimum(codes, CODES - 1), [END] * (end == len(text))]).astype(np.uint64)
    n = codes.size - ORDER + 1
    keys = codes[:n].copy()
    for k in range(1, ORDER):
        keys = keys << np.uint64(BITS) | codes[k : k + n]
    return keys.view(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if keys.size else n


def counted(texts: DataFrame) -> DataFrame:
    """(gram, n) over the texts in the first column, map-side combined in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def flush() -> pa.RecordBatch:
            keys, n = summed(*map(np.concatenate, held))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["gram", "n"])

        for whole in batches:
            for text in whole.column(0).to_pylist():
                for at in range(0, len(text or ""), PIECE):
                    keys, n = np.unique(grams(text, at, at + PIECE), return_counts=True)
                    held[0].append(keys)
                    held[1].append(n)
                if sum(map(len, held[0][1:])) > 1 << 19:
                    keys, n = summed(*map(np.concatenate, held))
                    held = [keys], [n]
                    if keys.size > 1 << 20:
                        yield flush()
                        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield flush()

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Counts of one order: the n-grams, their histories, and the discounts."""

    grams: DataFrame
    histories: DataFrame


def discounts(table: DataFrame) -> list[float]:
    """What is taken from n-grams seen once, twice and more often."""
    row = table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    share = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3]
    return [min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw)]


def levels(counts: DataFrame) -> list[Level]:
    """From the lowest order to the highest. Below the highest, an n-gram counts its distinct left neighbours."""
    out, table = [], counts
    for order in range(ORDER, 0, -1):
        table = materialize(table)
        d1, d2, d3 = discounts(table)
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        seen = table.select("gram", F.shiftrightunsigned("gram", BITS).alias("history"), "n", taken.alias("taken"))
        histories = seen.groupBy("history").agg(
            F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("rest")
        )
        out.append(
            Level(
                seen.select(F.col("gram").alias("__gram"), (F.col("n") - F.col("taken")).alias("left")),
                materialize(histories.withColumnRenamed("history", "__history")),
            )
        )
        if order > 1:
            table = table.groupBy(lowest(F.col("gram"), order - 1).alias("gram")).agg(F.count("*").alias("n"))
    return out[::-1]


def lowest(gram: Column, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << BITS * order) - 1))


def log_probabilities(wanted: DataFrame, model: list[Level]) -> DataFrame:
    """(gram, logp) for the distinct n-grams in ``wanted``, seen in the model or not.

    For each order the n-grams meet the counts of the n-gram and of its history in two joins that are
    sharded by key; an n-gram or history without a count leaves what the lower order gives.
    """
    rows = wanted.withColumn("p", F.lit(1.0 / CODES))
    for order, level in enumerate(model, 1):
        own = lowest(F.col("gram"), order)
        rows = rows.withColumns({"own": own, "history": F.shiftrightunsigned(own, BITS)})
        rows = rows.join(level.histories, F.col("history") == F.col("__history"), "left")
        rows = rows.join(level.grams, F.col("own") == F.col("__gram"), "left")
        better = F.coalesce("left", F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("p")
        rows = rows.select("gram", F.coalesce(better, "p").alias("p"))
    return rows.select("gram", F.log("p").alias("logp"))


def score(text: str, keys: np.ndarray, logps: np.ndarray) -> tuple[int, float]:
    total = 0.0
    for at in range(0, len(text), PIECE):
        total += float(logps[np.searchsorted(keys, grams(text, at, at + PIECE))].sum())
    return len(text) + 1, total


def bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id, one row per hash."""
    x = ids.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    first, step = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    return np.array([(first + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(BLOOM_HASHES)])


def maybe_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be one of ``ids`` (one long column): all that are, and few others.

    The filter's bits follow the number of ids up to ``BLOOM_MOST``; words of it are built in the
    tasks and or-ed by Spark. Only the key goes to Python, the other columns wait in the JVM. Beyond
    the largest filter more rows pass, so an exact join has to follow.
    """
    bits = 1 << min(max(ids.count() * BLOOM_BITS, 64).bit_length(), BLOOM_MOST.bit_length() - 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(bloom_places(np.asarray(batch.column(0)), bits))
            word, start = np.unique(places >> np.uint64(6), return_index=True)
            marks = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), start) if word.size else word
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(marks.view(np.int64))], ["word", "marks"]
            )

    parts = ids.mapInArrow(words, "word long, marks long").groupBy("word").agg(F.bit_or("marks").alias("marks"))
    found = parts.toPandas()
    table = np.zeros(bits >> 6, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["marks"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def hit(keys):
        known = keys.notna().to_numpy()
        places = bloom_places(keys.fillna(0).to_numpy(np.int64), bits)
        marked = shared.value[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)
        return keys.notna() & (marked.all(axis=0) & known)

    return rows.filter(hit(F.col(key)))


def thresholds(held: DataFrame, key: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(key, threshold): the quantile of the trusted perplexities that parts both kinds best.

    ``held`` has the key, role 2 (trusted) or 3 (junk) and the perplexity. Of ``quantiles`` the one
    with the largest sum of trusted kept and junk rejected is taken, of equal ones the largest, so
    without junk the largest of all.
    """
    limits = held.filter("role = 2").groupBy(F.col(key).alias("__key")).agg(
        F.percentile_approx("perplexity", list(quantiles), ACCURACY).alias("limits")
    )
    joined = left_join_unique(held, materialize(limits), key, "__key").filter(F.col("limits").isNotNull())

    def merit(k: int) -> Column:
        good = F.col("perplexity") <= F.col("limits")[k]
        kept = F.count_if((F.col("role") == 2) & good) / F.count_if(F.col("role") == 2)
        rejected = F.try_divide(F.count_if((F.col("role") == 3) & ~good), F.count_if(F.col("role") == 3))
        return kept + F.coalesce(rejected, F.lit(0.0))

    merits = joined.groupBy(key).agg(
        F.max("limits").alias("limits"), F.array(*[merit(k) for k in range(len(quantiles))]).alias("merits")
    )
    best = F.array_position("merits", F.array_max("merits")).cast("int") - 1
    return merits.select(key, F.get("limits", best).alias("threshold"))


ROW = "doc_id long, lang string, n_chars long, logp double"


def _table(ids, langs, texts: list, keys, logps) -> pa.RecordBatch:
    found = [score(t, keys, logps) if t else (0, 0.0) for t in texts]
    arrays = [ids, langs, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ROW.split(", ")])


def scored_by_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Scores from a table whose size was checked."""
    found = table.toPandas().sort_values("gram")
    keys, logps = found["gram"].to_numpy(np.int64), found["logp"].to_numpy(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((keys, logps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                yield _table(*b.columns[:2], b.column(2).to_pylist(), *shared.value)

    return rows.select("doc_id", "lang", "text").mapInArrow(run, ROW)


def scored_by_groups(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Scores where the table is too large to broadcast: each group of documents gets its own n-grams."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // GROUP_CHARS) + 1
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.asarray(batch.column(0))
            texts = batch.column(1).to_pylist()
            for g in np.unique(groups):
                own = [np.unique(grams(texts[i])) for i in np.flatnonzero(groups == g) if texts[i]]
                if own:
                    keys = np.unique(np.concatenate(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, g)), pa.array(keys)], ["grp", "gram"])

    wanted = grouped.select("grp", "text").repartition("grp").sortWithinPartitions("grp")
    wanted = wanted.mapInArrow(asked, "grp long, gram long").distinct()
    answers = wanted.join(table, "gram")

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("gram")
        keys, logps = np.asarray(known.column("gram")), np.asarray(known.column("logp"))
        texts = docs.column("text").to_pylist()
        columns = [docs.column(c).combine_chunks() for c in ("doc_id", "lang")]
        return pa.Table.from_batches([_table(*columns, texts, keys, logps)])

    return grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, ROW)


def perplexity_filter(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quality: str = "quality",
    quantiles: tuple[float, ...] = QUANTILES,
) -> DataFrame:
    """(doc_id, n_chars, perplexity, threshold, kept), one row per input row.

    The model is counted over all trusted documents, those labelled 1, but for one in ``HELD``. These
    set the threshold of their language, that of the ``quantiles`` of their perplexities which best parts
    them from as many in ``HELD`` of those labelled 0; a language without held trusted ones takes the
    one over all. A document is kept up to its threshold. Only trusted texts move, once.

    Null and empty texts have no perplexity and are not kept. Null languages are one language. A null
    id has no label; labels of one id are combined by the smaller, null labels are left out. Without
    trusted documents there is no threshold and every document with a text is kept. Repeated rows are
    returned as often as they came. Texts are scored whole, however long. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    held_out = F.pmod(F.xxhash64("__doc_id"), F.lit(HELD)) == 0
    good = F.col("__quality") == 1
    trusted = (
        labels.select(F.col(doc_id).cast("long").alias("__doc_id"), F.col(quality).cast("int").alias("__quality"))
        .filter("__doc_id IS NOT NULL AND __quality IS NOT NULL")
        .groupBy("__doc_id")
        .agg(F.min("__quality").alias("__quality"))
        # 1: counted, 2: trusted and held out, 3: junk and held out, 0: other junk
        .select("__doc_id", F.when(held_out, F.when(good, 2).otherwise(3)).otherwise(good.cast("int")).alias("role"))
    )
    trusted = materialize(trusted)
    counting = trusted.filter("role = 1").select("__doc_id")
    # trusted texts move, and the few others that the filter lets through; one plan at every size
    near = maybe_in(rows, counting, "doc_id")
    good = near.join(counting.hint("merge"), F.col("doc_id") == F.col("__doc_id"), "left_semi")
    model = levels(counted(good.select("text")))
    table = materialize(log_probabilities(counted(rows.select("text")).select("gram"), model))
    by = scored_by_table if table.count() <= BROADCAST_ROWS else scored_by_groups
    found = materialize(by(rows, table))
    perplexity = F.when(F.col("n_chars") > 0, F.exp(-F.col("logp") / F.col("n_chars"))).alias("perplexity")
    scores = materialize(
        found.join(trusted, F.col("doc_id") == F.col("__doc_id"), "left").select(
            "doc_id", "lang", "n_chars", F.coalesce("role", F.lit(0)).alias("role"), perplexity
        )
    )
    # a null language is a language
    scores = scores.withColumn("__key", F.struct("lang"))
    held = scores.filter("role IN (2, 3) AND perplexity IS NOT NULL").select("__key", "role", "perplexity")
    found = thresholds(held.withColumn("__key", F.struct(F.lit(0))), "__key", quantiles).first()
    limits = materialize(
        thresholds(held, "__key", quantiles).select(F.col("__key").alias("__lang"), F.col("threshold").alias("own"))
    )
    joined = left_join_unique(scores, limits, "__key", "__lang")
    threshold = F.coalesce("own", F.lit(math.inf if found is None else found["threshold"]))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return joined.withColumn("threshold", threshold).select(
        "doc_id", "n_chars", "perplexity", "threshold", kept.alias("kept")
    )
