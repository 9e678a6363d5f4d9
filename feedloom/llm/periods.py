"""Periodic runs of words: short periods by direct lag scans, longer ones seeded by minimizers."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run has at least so many words and so many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
# Periods below are scanned directly; each scale from here on covers periods up to twice its own.
SCAN = 64
# Words and windows of a scale, as a part of its smallest period.
PART = 4
# A periodic k-mer has a period of at most this part of it, so it lies in a run of a shorter period.
INNER = 4
# Words that are searched together.
TOGETHER_WORDS, TOGETHER_ROWS = 1 << 20, 2048
NEVER = np.uint64(2**64 - 1)


def least_length(period: int) -> int:
    return max(MIN_LENGTH, MIN_PERIODS * period)


def scanned(words: np.ndarray, period: int) -> list[tuple[int, int]]:
    """(start, length) of all stretches that keep a period and are long enough, by comparing at that lag."""
    if words.size <= period:
        return []
    breaks = np.flatnonzero(words[:-period] != words[period:])
    breaks = np.concatenate([[-1], breaks, [words.size - period]])
    equal = np.diff(breaks) - 1
    good = np.flatnonzero(equal + period >= least_length(period))
    return [(int(breaks[i]) + 1, int(equal[i]) + period) for i in good]


def reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far from ``at`` the words equal those ``lag`` further on, forwards or backwards, by growing blocks."""
    far, block = 0, 64
    while True:
        if step > 0:
            low, high = at + far, min(at + far + block, words.size - lag)
        else:
            low, high = max(at - far - block, 0), at - far
        if low >= high:
            return far
        differ = words[low:high] != words[low + lag : high + lag]
        if differ.any():
            return far + int(differ.argmax() if step > 0 else differ[::-1].argmax())
        far, block = far + high - low, 2 * block


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def is_smallest(words: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no divisor of the period is one; with four periods only divisors can be."""
    run = words[start : start + length]
    return all((run[: length - period // f] != run[period // f :]).any() for f in prime_factors(period))


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over each window of ``size``, a power of two, by doubling."""
    width = 1
    while width < size:
        values = pick(values[:-width], values[width:])
        width *= 2
    return values


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window; ``NEVER`` marks none."""
    if hashes.size < window:
        return np.zeros(0, np.int64)
    lowest = sliding(hashes, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    around = sliding(np.concatenate([edge, lowest, edge]), window, np.maximum)
    return np.flatnonzero((around == hashes) & (hashes != NEVER))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def found_runs(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    ``words`` are numbers of words, in which documents are parted by numbers that occur once, so no
    run crosses from one to the next; ``owner`` tells the document of each place.

    Periods below ``SCAN`` are found by lag scans. For periods from p to 2p - 1, hashes of k = p/4
    words are taken, without k-mers that are periodic themselves, which lie in runs already found.
    In a run of four periods every stretch of one period holds a k-mer that is left (or else its own
    short period would hold in the whole run), and the windows around it pick the same place one
    period later. So the pair of equal minimizers at that distance exists, and a place has at most
    2 * PART * INNER equal ones in reach, for equal k-mers that are not periodic are more than k/4 apart.
    """
    runs: dict[tuple[int, int], int] = {}
    for period in range(1, SCAN):
        for start, length in scanned(words, period):
            # a stretch that also keeps a shorter period was found with it
            runs.setdefault((start, length), period)
    longest = int(np.bincount(owner).max(initial=0))
    hashes, k, scale = mixed(words.astype(np.uint64) + np.uint64(1)), 1, SCAN
    while MIN_PERIODS * scale <= longest:
        while k < scale // PART:
            hashes = mixed(hashes[:-k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:])
            k *= 2
        inside = np.zeros(words.size + 1, np.int64)
        for (start, length), period in runs.items():
            if period * INNER <= k <= length:
                inside[start] += 1
                inside[start + length - k + 1] -= 1
        usable = (np.cumsum(inside)[: hashes.size] == 0) & (owner[: hashes.size] == owner[k - 1 :])
        places = minimizers(np.where(usable, np.minimum(hashes, NEVER - np.uint64(1)), NEVER), k)
        for start, length, period in seeded(words, owner, places, hashes[places], scale):
            runs.setdefault((start, length), period)
        scale *= 2
    return sorted(((start, length, period) for (start, length), period in runs.items()), key=lambda r: (r[0], r[2]))


def seeded(words: np.ndarray, owner: np.ndarray, places: np.ndarray, keys: np.ndarray, scale: int):
    """Runs with a period from ``scale`` to twice that, extended from equal minimizers at that distance."""
    order = np.lexsort((places, keys))
    places, keys = places[order], keys[order]
    done: dict[int, int] = {}
    pairs = []
    for ahead in range(1, places.size):
        far = places[ahead:] - places[:-ahead]
        near = (keys[ahead:] == keys[:-ahead]) & (far < 2 * scale)
        if not near.any():
            break
        near &= (far >= scale) & (owner[places[ahead:]] == owner[places[:-ahead]])
        pairs += zip(places[:-ahead][near].tolist(), far[near].tolist(), strict=True)
    for at, lag in sorted(pairs):
        if at < done.get(lag, -1):
            continue
        ahead = reach(words, at, lag, 1)
        behind = reach(words, at, lag, -1)
        done[lag] = at + ahead
        start, length = at - behind, behind + ahead + lag
        if length >= least_length(lag) and is_smallest(words, start, length, lag):
            yield start, length, lag


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten made periodic from some place on."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def measured(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    numbers: dict[bytes, int] = {}
    parts, owners = [], []
    for i, words in enumerate(texts):
        own = [numbers.setdefault(w, len(numbers)) for w in words]
        parts.append(np.array([*own, -1 - i], np.int64))
        owners.append(np.full(len(own) + 1, i))
    starts = np.cumsum([0] + [p.size for p in parts[:-1]])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if texts:
        owner = np.concatenate(owners)
        for start, length, period in found_runs(np.concatenate(parts), owner):
            i = int(owner[start])
            out[i].append((start - int(starts[i]), length, period))
    return out


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period and exponent_milli of the top run, hashes of the runs and of what is kept."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    top: tuple = (None,) * 4
    if runs:
        start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        top = (start, length, period, 1000 * length // period)
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


ROW = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
KINDS = [*[pa.int64()] * 5, pa.string(), pa.string()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per input row.

    The words of one document in ten, chosen by the CRC32 of its id, are made periodic first. A run
    is a stretch of words with a smallest period, at least four periods and six words long, that does
    not go on at either end. The collapsed text drops what follows the first period of a run.

    Documents are searched together up to about a million words, a longer one by itself, without a
    shuffle; a document's words are held in one task, as its text is.

    Null and empty texts and texts without a run have none: n_runs is 0, the top run null, and the
    hashes are those of '' and of all words. A null id leaves the words as they are. Of equal
    exponents the smallest start, then period, is the top run. Repeated rows are measured alike.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = measured([words for _, words in held])
            rows = [summary(words, runs) for (_, words), runs in zip(held, found, strict=True)]
            arrays = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
            names = [c.split()[0] for c in ROW.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), *arrays], names)

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                words = planted((batch.column(1)[i].as_py() or "").encode().split(), own)
                if held and (size + len(words) > TOGETHER_WORDS or len(held) >= TOGETHER_ROWS):
                    yield flush()
                    held, size = [], 0
                held.append((own, words))
                size += len(words)
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ROW)
