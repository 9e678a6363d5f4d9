"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.session import materialize

SEED = 42
CHUNK = 1 << 16
# A block of up to this many distinct fingerprints is compared within one task. Larger blocks are
# cut by finer masks that leave at most 13 bits open, so 2**13 fingerprints.
BLOCK_ROWS = 1 << 13


def fingerprint(data: bytes, shingle: int) -> int:
    """The majority of each bit over the hashes of all shingles; zero without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(words) - shingle + 1, 1)
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(firsts[at : at + CHUNK], lasts[at : at + CHUNK], strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fingerprint as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fingerprint"]
            )

    whole = F.col(text).cast("string")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text_hash(whole), whole.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_hash string, fingerprint long")


def _text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit(""))).alias("text_hash")


def _document(doc_id: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash)


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of nearly equal length over the given bit positions."""
    return [sum(1 << int(b) for b in run) for run in np.array_split(np.array(bits), n)]


def block_masks(max_bits: int) -> list[list[int]]:
    """Per table the coarse mask, followed by the finer masks for blocks that are too large.

    With twice ``max_bits`` parts, two fingerprints that differ in at most ``max_bits`` bits agree on
    some ``max_bits`` whole parts. The open bits are cut the same way once more, into enough parts
    that the bits left open are few.
    """
    parts = _parts(list(range(64)), 2 * max_bits) if max_bits else [(1 << 64) - 1]
    tables = []
    for kept in combinations(parts, max_bits or 1):
        coarse = sum(kept)
        open_bits = [b for b in range(64) if not coarse >> b & 1]
        fine = _parts(open_bits, 3 * max_bits - 1) if max_bits else []
        finer = [coarse + sum(c) for c in combinations(fine, len(fine) - max_bits)]
        tables.append([coarse, *finer])
    return tables


def forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the link graph among a block's distinct fingerprints."""
    tails, heads, left = [], [], prints
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                tails.append(np.full(found.size, x))
                heads.append(found)
                todo.extend(found)
                left = left[~near]
    if not tails:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(tails), np.concatenate(heads)


def spread(masks: list[list[int]], fine: bool) -> Callable:
    """Rows (table, key, fingerprint) for each block a fingerprint belongs to."""
    coarse = np.array([m[0] for m in masks], np.uint64)
    finer = [np.array(m[1:], np.uint64) for m in masks]
    kinds = pa.schema([("tab", pa.int32()), ("block", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64)
            if fine:
                tables = np.asarray(batch.column(0))
                groups = [(int(t) << 10, prints[tables == t], finer[t]) for t in np.unique(tables)]
            else:
                groups = [(0, prints, coarse)]
            for base, own, used in groups:
                for at in range(0, own.size, 4096):
                    part = own[at : at + 4096]
                    keys = (part[:, None] & used[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.tile(np.arange(used.size, dtype=np.int32) + base, part.size)),
                            pa.array(keys.view(np.int64)),
                            pa.array(np.repeat(part, used.size).view(np.int64)),
                        ],
                        schema=kinds,
                    )

    return run


def link_blocks(max_bits: int, limit: int | None) -> Callable:
    """Scan rows sorted by block: edges of each block, or its rows unchanged if it is over ``limit``.

    Output (tab, a, b): an edge has a null ``tab``; a row of a large block has a null ``b``.
    """
    kinds = pa.schema([("tab", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def edges(tails, heads):
        nulls = pa.nulls(tails.size, pa.int32())
        return pa.RecordBatch.from_arrays(
            [nulls, pa.array(tails.view(np.int64)), pa.array(heads.view(np.int64))], schema=kinds
        )

    def heavy(table, prints):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(prints.size, table, np.int32)),
                pa.array(prints.view(np.int64)),
                pa.nulls(prints.size, pa.int64()),
            ],
            schema=kinds,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large = None, np.zeros(0, np.uint64), False

        def close():
            if not large and held.size > 1:
                tails, heads = forest(np.unique(held), max_bits)
                if tails.size:
                    yield edges(tails, heads)

        for batch in batches:
            if not batch.num_rows:
                continue
            tables, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            prints = np.asarray(batch.column(2)).view(np.uint64)
            new = np.flatnonzero((tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [tables.size]])
            # single rows inside the batch link to nothing; the first and the last may go on
            worth = np.flatnonzero(ends - starts > 1).tolist()
            for i in sorted({0, len(starts) - 1, *worth}):
                own = prints[starts[i] : ends[i]]
                now = (int(tables[starts[i]]), int(keys[starts[i]]))
                if now != key:
                    yield from close()
                    key, held, large = now, own, False
                elif not large:
                    held = np.concatenate([held, own])
                if large:
                    yield heavy(key[0], own)
                elif limit is not None and held.size > limit:
                    yield heavy(key[0], held)
                    large, held = True, held[:0]
        yield from close()

    return run


def linked_pairs(prints: DataFrame, max_bits: int, limit: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints of ``prints`` as all links would."""
    masks = block_masks(max_bits)
    row = "tab int, block long, fp long"
    blocks = prints.select(F.col("fingerprint").alias("fp")).mapInArrow(spread(masks, False), row)
    found = materialize(
        blocks.repartition("tab", "block")
        .sortWithinPartitions("tab", "block")
        .mapInArrow(link_blocks(max_bits, limit), "tab int, a long, b long")
    )
    large = found.filter(F.col("tab").isNotNull()).select("tab", F.col("a").alias("fp"))
    finer = large.mapInArrow(spread(masks, True), row)
    rest = (
        finer.repartition("tab", "block")
        .sortWithinPartitions("tab", "block")
        .mapInArrow(link_blocks(max_bits, None), "tab int, a long, b long")
    )
    return found.filter(F.col("tab").isNull()).select("a", "b").unionByName(rest.select("a", "b"))


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and (__print, root): the component of each fingerprint."""
    rows = materialize(with_fingerprint(docs, doc_id, text, shingle))
    prints = materialize(rows.select("fingerprint").distinct())
    roots = materialize(components(linked_pairs(prints, max_bits), "a", "b"))
    rooted = prints.join(roots, F.col("fingerprint") == F.col("node"), "left")
    return rows, materialize(
        rooted.select(F.col("fingerprint").alias("__print"), F.coalesce("root", "fingerprint").alias("root"))
    )


def text_versions(docs: DataFrame, doc_id: str, text: str, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(text_hash, version): for the MD5 of each distinct text a number that its near copies share."""
    rows, roots = _grouped(docs, doc_id, text, shingle, max_bits)
    texts = rows.select("text_hash", "fingerprint").distinct()
    return texts.join(roots, F.col("fingerprint") == F.col("__print")).select("text_hash", F.col("root").alias("version"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Words are split at ASCII white space and lower-cased in A-Z; ``shingle`` words are hashed with
    XXH64 (fewer words: the whole sequence), and a bit of the fingerprint is the strict majority.
    Fingerprints at most ``max_bits`` apart are linked; ``component_id`` is the smallest id reachable.

    Exact copies meet in one fingerprint before anything is joined, so a group of copies of any size
    is one row of the blocks. Only a spanning forest leaves a block, never its pairs.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any
    other. Rows with a null id link too, but never name a component: theirs is the smallest id that
    is not null, or null. Repeated rows are returned as often as they came. Other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    rows, roots = _grouped(docs, doc_id, text, shingle, max_bits)
    firsts = rows.groupBy(F.col("fingerprint").alias("__first_print")).agg(F.min("doc_id").alias("first_id"))
    rooted = materialize(roots.join(firsts, F.col("__print") == F.col("__first_print")))
    lowest = materialize(rooted.groupBy(F.col("root").alias("__root")).agg(F.min("first_id").alias("component_id")))
    named = materialize(
        rooted.join(lowest, F.col("root") == F.col("__root")).select("__print", "component_id")
    )
    return rows.join(named, F.col("fingerprint") == F.col("__print")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def unique_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; same columns.

    Null ids come last; equal ids are ordered by the hash of the text, and rows that agree in both
    by a hash of all their columns. Texts move once.
    """
    rows, roots = _grouped(docs, doc_id, text, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # copies of a fingerprint meet in one row each before the components do
    firsts = rows.groupBy(F.col("fingerprint").alias("__first_print")).agg(F.min(order).alias("first"))
    joined = materialize(roots.join(firsts, F.col("__print") == F.col("__first_print")))
    kept = joined.groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(kept.select(_document(F.col("first.doc_id"), F.col("first.text_hash")).alias("__kept")))
    values = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    own = _document(F.col(doc_id).cast("long"), _text_hash(F.col(text).cast("string")))
    # names that the table does not have
    taken = max(map(len, docs.columns))
    key, every, rank = (f"__{name}_".ljust(taken + 1, "_") for name in ("own", "all", "n"))
    marked = docs.withColumns({key: own, every: F.xxhash64(*values)})
    # one key for both, so that the window finds the rows where the join has put them
    repeats = Window.partitionBy(key).orderBy(every)
    kept = kept.withColumnRenamed("__kept", f"{key}kept")
    first = marked.join(kept, F.col(key) == F.col(f"{key}kept"), "left_semi")
    first = first.withColumn(rank, F.row_number().over(repeats)).filter(F.col(rank) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
