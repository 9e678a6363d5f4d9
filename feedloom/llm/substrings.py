"""Repeated passages: level-wise doubling of word windows, removal of all but the first place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize

# Odd multipliers of the window hash and its mixing.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WRAP = (1 << 64) - 1
# Documents hashed together, and anchors that one shard of the exchange holds about.
TOGETHER, SHARD_ROWS = 1024, 100_000
LEAST_SHARDS = 1024
# One in so many documents is looked at to foresee frequent windows. A window is taken for frequent
# from this share of those documents, and this many of them; that decides only how it travels.
SAMPLE, FREQUENT_SHARE, FREQUENT_LEAST = 16, 0.002, 8

ROW = "shard int, kind int, hashes binary, docs binary, tags binary, places binary, masks binary, windows binary"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
ANCHOR, WINDOW, REMOVED = 0, 1, 2
CUT = "doc_id long, tag int, places binary"
# Offsets of an anchor in its windows, one bit each.
MOST_OFFSETS = 64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * MIX
    return hashes ^ (hashes >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on, by doubling: from the hashes of shorter windows."""
    known, hashes, power = 1, words, STEP
    while known < length:
        more = min(known, length - known)
        if more < known:  # the last step overlaps, so it doubles a shorter window
            hashes = hashes[: words.size - length + 1] * power + hashes[more : words.size - known + 1]
            return mixed(hashes + np.uint64(more))
        n = max(words.size - 2 * known + 1, 0)
        hashes = hashes[:n] * power + hashes[known : known + n]
        known, power = 2 * known, np.uint64(int(power) ** 2 & WRAP)
    return mixed(hashes)


@dataclass
class Anchors:
    """Short windows that stand for the long ones around them.

    Of the short windows in a long one, the one with the smallest hash is its anchor. It follows from
    the long window's words alone, so equal long windows have the same anchor at the same offset.
    Bit j of ``masks`` says that the long window starting j words before the anchor is its own.
    """

    places: np.ndarray
    hashes: np.ndarray
    masks: np.ndarray


def anchors_of(words: np.ndarray, doc: np.ndarray, window: int, short: int) -> Anchors:
    """Anchors over the concatenated words of several documents; ``doc`` numbers each word's document."""
    n, width = words.size - window + 1, window - short + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(none, none.astype(np.uint64), none.astype(np.uint64))
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    hashes = window_hashes(words, short)
    if not whole.size:
        return Anchors(none, none.astype(np.uint64), none.astype(np.uint64))
    lowest, offset = hashes[whole], np.zeros(whole.size, np.int64)
    for k in range(1, width):
        other = hashes[whole + k]
        less = other < lowest
        lowest, offset = np.where(less, other, lowest), np.where(less, k, offset)
    at = whole + offset
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    masks = np.bitwise_or.reduceat(np.uint64(1) << offset.astype(np.uint64), starts)
    return Anchors(at[starts], hashes[at[starts]], masks)


def anchor_length(window: int) -> int:
    """Half the window, or so much more that the offsets of an anchor fit into its mask."""
    return max((window + 1) // 2, window - MOST_OFFSETS + 1)


def mask_type(offsets: int) -> np.dtype:
    return next(np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.uint64) if offsets <= 8 * np.dtype(k).itemsize)


def long_windows(masks: np.ndarray, offsets: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and offsets of all bits that are set, by row, then offset."""
    every = np.arange(offsets, dtype=masks.dtype)
    return np.nonzero(masks[:, None] >> every & masks.dtype.type(1))


def later(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows whose key also occurs with a smaller document."""
    if not keys.size:
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    first = np.minimum.reduceat(docs[order], starts)
    out = np.zeros(keys.size, bool)
    out[order] = docs[order] > np.repeat(first, np.diff(np.concatenate([starts, [keys.size]])))
    return out


def _packed(shard: int, kind: int, *arrays: np.ndarray) -> list:
    return [shard, kind, *[a.tobytes() for a in arrays], *[None] * (6 - len(arrays))]


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shards, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(shards[order]) != 0])) if shards.size else []
    for rows in np.split(order, starts[1:]) if shards.size else []:
        yield int(shards[rows[0]]), rows


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, COLUMNS)


def _read(batch: pa.RecordBatch, known: WordHashes) -> tuple[np.ndarray, ...]:
    """Word hashes of all texts of a batch, and each word's row and place in it."""
    if len(known) > 1_000_000:
        known.clear()
    found = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in batch.column(2)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    words = np.fromiter((known[w] for words in found for w in words), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(sizes.size), sizes)
    return words, doc, np.arange(words.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def scatter(window: int, short: int, shards: int, frequent: np.ndarray):
    """Anchors with the hashes of their long windows, and frequent windows, packed by shard.

    What a smaller document of the same batch already has is settled here and travels as removed
    places, so a passage or a group of copies of any size sends few rows per batch.
    """
    offsets = window - short + 1
    mask = mask_type(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                yield from one(whole.slice(at, TOGETHER), known)

    def one(batch, known):
        ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        words, doc, place = _read(batch, known)
        found = anchors_of(words, doc, window, short)
        if not found.places.size:
            return
        rows = []
        often = np.isin(found.hashes, frequent)

        anchor, offset = long_windows(found.masks, offsets)
        starts = found.places[anchor] - offset
        keys = window_hashes(words, window)[starts]
        late = later(keys, ids[doc[starts]])
        gone_doc, gone_place = doc[starts[late]], place[starts[late]]
        anchor, offset, starts, keys = (x[~late] for x in (anchor, offset, starts, keys))

        # frequent anchors: each long window by itself
        alone = often[anchor]
        for shard, own in _by_shard((keys[alone] % np.uint64(shards)).astype(np.int64)):
            s = starts[alone][own]
            rows.append(_packed(shard, WINDOW, keys[alone][own], ids[doc[s]], tags[doc[s]], place[s].astype(np.int32)))

        # the others: the anchor with the hashes of the long windows that are left to it
        anchor, offset, keys = anchor[~alone], offset[~alone], keys[~alone]
        firsts = np.flatnonzero(np.diff(anchor, prepend=-1))
        ends = np.append(firsts[1:], anchor.size)
        at, hashes = found.places[anchor[firsts]], found.hashes[anchor[firsts]]
        masks = np.zeros(firsts.size, np.uint64)
        if firsts.size:
            masks = np.bitwise_or.reduceat(np.uint64(1) << offset.astype(np.uint64), firsts)
        for shard, own in _by_shard((hashes % np.uint64(shards)).astype(np.int64)):
            a = at[own]
            where = ids[doc[a]], tags[doc[a]], place[a].astype(np.int32)
            windows = np.concatenate([keys[firsts[i] : ends[i]] for i in own])
            short_hashes = (hashes[own] >> np.uint64(32)).astype(np.uint32)
            rows.append(_packed(shard, ANCHOR, short_hashes, *where, masks[own].astype(mask), windows))

        for d, own in _by_shard(gone_doc):
            places = gone_place[own].astype(np.int32)
            shard = int(mixed(ids[d : d + 1].view(np.uint64))[0] % np.uint64(shards))
            rows.append(_packed(shard, REMOVED, np.zeros(0, np.uint64), ids[d : d + 1], tags[d : d + 1], places))
        yield _batch(rows)

    return run


def gather(window: int, short: int):
    """Per shard: anchors that several documents have go on to their long windows, whose hashes are compared.

    32 bits of an anchor's hash travel, which decide nothing but which windows are looked at.
    """
    offsets = window - short + 1
    mask = mask_type(offsets)

    def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, tags, places = [], [], []

        def take(own, kind, name):
            return np.concatenate([np.frombuffer(r[name], kind) for r in own])

        if own := [r for r in rows if r["kind"] == WINDOW]:
            d = take(own, np.int64, "docs")
            late = later(take(own, np.uint64, "hashes"), d)
            docs.append(d[late])
            tags.append(take(own, np.int32, "tags")[late])
            places.append(take(own, np.int32, "places")[late])
        if own := [r for r in rows if r["kind"] == ANCHOR]:
            hashes, d = take(own, np.uint32, "hashes"), take(own, np.int64, "docs")
            t, p, m = take(own, np.int32, "tags"), take(own, np.int32, "places"), take(own, mask, "masks")
            # windows that are repeated at the short length alone go on to the long one
            shared = later(hashes, d) | later(hashes, -1 - d)
            anchor, offset = long_windows(m, offsets)
            on = shared[anchor]
            anchor, offset = anchor[on], offset[on]
            late = later(take(own, np.uint64, "windows")[on], d[anchor])
            docs.append(d[anchor[late]])
            tags.append(t[anchor[late]])
            places.append((p[anchor] - offset)[late].astype(np.int32))
        done = [r for r in rows if r["kind"] == REMOVED]
        out = [
            (int(np.frombuffer(r["docs"], np.int64)[0]), int(np.frombuffer(r["tags"], np.int32)[0]), r["places"])
            for r in done
        ]
        if docs:
            docs, tags, places = np.concatenate(docs), np.concatenate(tags), np.concatenate(places)
            order = np.lexsort((tags, docs))
            docs, tags, places = docs[order], tags[order], places[order]
            if docs.size:
                new = np.flatnonzero(np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(tags) != 0)]))
                for i, part in zip(new.tolist(), np.split(places, new[1:]), strict=True):
                    out.append((int(docs[i]), int(tags[i]), part.astype(np.int32).tobytes()))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield from settle(held)
                    held = []
                held.append(row)
        if held:
            yield from settle(held)

    return run


def _tagged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with equal ids are told apart by a tag of their text."""
    whole = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _tag(whole).alias("tag"), whole.alias("text"))


def _tag(text: Column) -> Column:
    return F.hash(F.coalesce(text, F.lit("")))


def frequent_windows(rows: DataFrame, window: int, short: int) -> tuple[np.ndarray, int]:
    """Anchors that a hash sample of the documents has often, and how many anchors there are in all.

    No more than the anchors of ``1 / FREQUENT_SHARE`` average documents can be that frequent.
    """
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                words, doc, _ = _read(batch, known)
                found = anchors_of(words, doc, window, short)
                pairs = np.unique(np.stack([found.hashes, doc[found.places].astype(np.uint64)], 1), axis=0)
                hashes, counts = np.unique(pairs[:, 0], return_counts=True)
                arrays = [
                    pa.array(np.concatenate([hashes, [0, 0]]).astype(np.uint64).view(np.int64)),
                    pa.array(np.concatenate([counts, [batch.num_rows, found.places.size]])),
                    pa.array([0] * hashes.size + [1, 2], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["hash", "n", "kind"])

    counts = materialize(
        sample.mapInArrow(run, "hash long, n long, kind int").groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    )
    totals = {r["kind"]: r["n"] for r in counts.filter("kind > 0").collect()}
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * totals.get(1, 0))
    often = counts.filter((F.col("kind") == 0) & (F.col("n") >= least)).select("hash").toPandas()["hash"]
    return often.to_numpy(np.int64).view(np.uint64), totals.get(2, 0) * SAMPLE


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """(doc_id, tag, places): starts of windows that also start in a document with a smaller id.

    Windows of ``window`` words are found from windows of half the length, doubled. In each long
    window the short one with the smallest hash is its anchor; only of anchors that several documents
    share are the long windows compared, by the whole 64 bits of their hashes. ``places`` are 32-bit numbers
    of words. Anchors travel packed, by shards of about ``SHARD_ROWS`` anchors.
    """
    short = anchor_length(window)
    rows = _tagged(docs, doc_id, text).filter(F.col("doc_id").isNotNull())
    frequent, total = frequent_windows(rows, window, short)
    shards = max(LEAST_SHARDS, -(-total // SHARD_ROWS))
    sent = rows.mapInArrow(scatter(window, short, shards, np.sort(frequent)), ROW)
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(gather(window, short), CUT)


def _covered(n: int, places: list[bytes] | None, window: int) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    if places:
        starts = np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in places]))
        cover[starts] += 1
        cover[np.minimum(starts + window, n)] -= 1
    return np.cumsum(cover[:n]) > 0


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, texts: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per input row.

    Words are split at ASCII white space. A word goes if a window of ``window`` words that covers it
    also starts in a document with a smaller id, as judged on the input. The hash is of the kept
    words, joined by one space; ``texts`` returns them too.

    Null and empty texts have no words. Rows with a null id are compared with nothing and keep all.
    Rows with equal ids do not remove each other's words. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    places = repeated_places(docs, doc_id, text, window).groupBy("doc_id", "tag")
    places = places.agg(F.collect_list("places").alias("places"))
    found = materialize(places.select(F.col("doc_id").alias("__doc_id"), F.col("tag").alias("__tag"), "places"))
    rows = _tagged(docs, doc_id, text)
    joined = rows.join(found, (F.col("doc_id") == F.col("__doc_id")) & (F.col("tag") == F.col("__tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, hashes, kept_texts = [], [], [], []
            for t, places in zip(batch.column(1), batch.column(2), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                cover = _covered(len(words), places.as_py(), window)
                lost = int(cover.sum())
                kept = [w for w, c in zip(words, cover.tolist(), strict=True) if not c] if lost else words
                data = b" ".join(kept)
                sizes.append(len(words))
                gone.append(lost)
                hashes.append(hashlib.sha256(data).hexdigest())
                kept_texts.append(data)
            counts = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            arrays = [batch.column(0), *counts, pa.array(hashes, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                arrays.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return joined.select("doc_id", "text", "places").mapInArrow(run, schema)
