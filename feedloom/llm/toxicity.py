"""Toxicity: noisy-channel restoration of disguised words, then a classifier over the restored text."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize

# The language model's alphabet: a boundary, a to z, any other letter. Its size bounds the model.
BOUNDARY, OTHER = 0, 27
SYMBOLS, ORDER = 28, 4
CONTEXTS = SYMBOLS ** (ORDER - 1)
# Letters that a character of leetspeak can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# What the channel's steps cost, as negative logarithms.
COST_LEET, COST_SKIP, COST_BREAK, COST_REPEAT, COST_DOUBLE = 1.0, 1.5, 0.7, 0.5, 4.0
# A masked letter may be any letter, each at this cost; a longer run of masks tells nothing about them.
COST_MASK, MASKS, MASKED = 1.0, "*#_", 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Per character, what it costs to leave a token with a digit and without a letter as it is.
COST_PLAIN = math.log(10)
# Single characters with white space between them, three or more.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t ]\S){2,}(?!\S)")
# What can be stripped from a token: it stands for no letter.
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET) + "«»“”‘’„¿¡…–—"
# Labelled rows that the classifier is fitted on, at most about.
SAMPLE_ROWS = 12_000
MIN_Z, MIN_DOCS, RIDGES, STEPS = 3.0, 4, (1.0, 0.1, 10.0), 30
# One in so many sampled texts chooses the ridge.
CHOOSE = 5
NAMES = ["feature", "n0", "n1", "bits0", "bits1"]
EVIDENCE = "feature string, n0 long, n1 long, bits0 long, bits1 long"
# Conjugate gradients: how far a step's remainder falls, and after how many turns it is taken as it is.
SMALL, TURNS = 1e-9, 500
REMEMBERED = 300_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def _classes() -> np.ndarray:
    """Symbol of each code point; what is outside the table is a letter of its own kind."""
    table = np.full(1 << 16, BOUNDARY, np.uint8)
    table[[c for c in range(1 << 16) if chr(c).isalpha()]] = OTHER
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else OTHER


def character_counts(texts: Iterable[str], table: np.ndarray) -> np.ndarray:
    """Counts of all runs of ``ORDER`` symbols, with one boundary between words."""
    codes = np.frombuffer(" ".join(texts).lower().encode("utf-32-le"), np.uint32)
    symbols = np.where(codes < table.size, table[np.minimum(codes, table.size - 1)], OTHER).astype(np.int64)
    symbols = np.concatenate([[BOUNDARY] * (ORDER - 1), symbols, [BOUNDARY]])
    keep = (symbols != BOUNDARY) | np.concatenate([[True] * (ORDER - 1), symbols[ORDER - 2 : -1] != BOUNDARY])
    symbols = symbols[keep]
    grams = symbols[: symbols.size - ORDER + 1].copy()
    for k in range(1, ORDER):
        grams = grams * SYMBOLS + symbols[k : k + grams.size]
    return np.bincount(grams, minlength=SYMBOLS**ORDER)


def character_model(docs: DataFrame, text: str) -> np.ndarray:
    """Cost of each symbol after each context, from all texts; at most ``SYMBOLS ** ORDER`` counts."""
    table = _classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                total += character_counts([t for t in whole.column(0).slice(at, 256).to_pylist() if t], table)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "gram long, n long")
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return costs(counts)


def costs(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolation from the longest context down to none."""
    prob = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        own = counts.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
        total, kinds = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        lower = np.tile(prob.reshape(-1, SYMBOLS), (own.shape[0] // (prob.size // SYMBOLS), 1))
        prob = (own + kinds * lower) / np.maximum(total + kinds, 1)
        prob = np.where(total > 0, prob, lower)
    return -np.log(prob).reshape(CONTEXTS, SYMBOLS).astype(np.float32)


class Channel:
    """The most likely words behind a disguised token: lattice of readings, character model, Viterbi."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """Per run of equal characters what it can stand for; the empty text skips, a space breaks."""
        lattice = []
        for match in re.finditer(r"(.)\1*", token, re.DOTALL):
            char, n = match[1], len(match[0])
            if char.isalpha():
                options = [(char * min(n, 2), COST_REPEAT * (n > 2))]
                if n > 1:
                    options.append((char, COST_REPEAT if n > 2 else COST_DOUBLE))
            elif char.isspace():
                options = [("", 0.0), (" ", COST_BREAK)]
            else:
                options = [("", COST_SKIP), (" ", COST_BREAK)]
                if char in MASKS and n <= MASKED and any(c.isalpha() for c in token):
                    # one step for each masked letter
                    lattice += [[("", COST_SKIP / n), *[(c, COST_MASK) for c in LETTERS]]] * (n - 1)
                    options += [(c, COST_MASK) for c in LETTERS]
                for k in {1, min(n, 2)}:
                    options += [(c * k, COST_LEET + COST_REPEAT * (n > k)) for c in LEET.get(char, "")]
            lattice.append(options)
        return lattice

    def best(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, list[str]]:
        """Cost and words of the cheapest path; all contexts are kept, and a path is a chain of its steps."""
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in [*lattice, [(" ", 0.0)]]:
            after: dict[int, tuple[float, tuple | None]] = {}
            for context, (cost, path) in paths.items():
                for out, extra in options:
                    state, total = context, cost + extra
                    for char in out:
                        if char == " " and state % SYMBOLS == BOUNDARY:
                            continue
                        s = BOUNDARY if char == " " else symbol(char)
                        total += self.model.item(state, s)
                        state = (state * SYMBOLS + s) % CONTEXTS
                    if state not in after or total < after[state][0]:
                        after[state] = (total, (path, out) if out else path)
            paths = after
        cost, path = min(paths.values(), key=lambda x: x[0])
        text = []
        while path:
            path, out = path
            text.append(out)
        return cost, "".join(reversed(text)).split()

    def decode(self, token: str) -> list[str]:
        return self.best(self.readings(token))[1]

    def letterless(self, token: str) -> list[str]:
        """What is written without any letter: read as letters where it can be, or a number as it is."""
        if not any(c in LEET for c in token):
            return []
        lattice = self.readings(token)
        # a character that can be a letter is one, or else nothing would be the likeliest word
        lattice = [[o for o in options if o[0].strip()] or options for options in lattice]
        cost, words = self.best(lattice)
        size = sum(not c.isspace() for c in token)
        return [] if any(c.isdigit() for c in token) and COST_PLAIN * size <= cost else words

    def words(self, token: str) -> list[str]:
        """Restored words of a lower-cased token."""
        core = token.strip(EDGES)
        if core.isalpha() and not re.search(r"(.)\1", core):
            return [core]
        return self.decode(core) if any(c.isalpha() for c in core) else self.letterless(core)

    def spaced(self, text: str) -> tuple[str, list[str]]:
        """The text without its spaced-out words, and those words restored."""
        found: list[str] = []

        def take(match: re.Match) -> str:
            run = match[0]
            words = self.decode(run) if any(c.isalpha() for c in run) else self.letterless(run)
            if not words:
                return run
            found.extend(words)
            return " "

        return SPACED.sub(take, text), found

    def restored(self, text: str) -> list[str]:
        rest, words = self.spaced(text.lower())
        return [w for t in rest.split() for w in self.words(t)] + words


def features_of(word: str) -> list[str]:
    """The word, and its beginnings, which its forms share."""
    if len(word) < 3:
        return []
    return [word, *[word[:k] + "*" for k in (4, 5, 6) if len(word) > k]]


def counted(channel: Channel, wanted: dict[str, int] | None = None):
    """A function from a text to its number of words and the counts of its features.

    With ``wanted`` only those features count, by their number. Tokens seen before are remembered.
    """
    known: dict[str, list] = {}

    def of_words(words: list[str]) -> list:
        every = [f for w in words for f in features_of(w)]
        return every if wanted is None else [wanted[f] for f in every if f in wanted]

    def count(text: str) -> tuple[int, Counter]:
        if len(known) > REMEMBERED:
            known.clear()
        rest, words = channel.spaced(text.lower())
        tokens, found = rest.split(), Counter(of_words(words))
        for token in tokens:
            own = known.get(token)
            if own is None:
                own = known[token] = of_words(channel.words(token))
            if own:
                found.update(own)
        return len(tokens) + len(words), found

    return count


def values(n_words: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per known feature of a text how often, and how densely."""
    return np.log1p(counts), np.log1p(1000 * counts / (n_words + 50))


def evidence(channel: Channel):
    """A function from a text to its features, each with 64 bits that mark the neighbours it stands between."""
    known: dict[str, list[str]] = {}

    def find(text: str) -> dict[str, int]:
        if len(known) > REMEMBERED:
            known.clear()
        rest, spaced = channel.spaced(text.lower())
        tokens, bits = rest.split(), {}
        for i, token in enumerate(tokens):
            if token not in known:
                known[token] = [f for w in channel.words(token) for f in features_of(w)]
            if known[token]:
                near = f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}"
                mark = 1 << (zlib.crc32(near.encode()) & 63)
                for f in known[token]:
                    bits[f] = bits.get(f, 0) | mark
        for i, word in enumerate(spaced):
            mark = 1 << (zlib.crc32(" ".join(spaced[max(i - 1, 0) : i + 2]).encode()) & 63)
            for f in features_of(word):
                bits[f] = bits.get(f, 0) | mark
        return bits

    return find


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def pick_features(rows: DataFrame, channel: Channel, n1: int, n0: int) -> list[str]:
    """Features whose share of toxic texts stands out from that of all texts.

    A feature's texts count as often as it stands between different neighbours, so that copies of a
    text, exact or edited elsewhere, are one piece of evidence. The share is tested by the likelihood
    ratio, at a bar that one of as many chance features as are tested would reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = evidence(channel)
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f, bits in find(text or "").items():
                    own = found.setdefault(f, [0, 0, 0, 0])
                    own[label] += 1
                    own[2 + label] |= bits
            sides = zip(*found.values(), strict=True) if found else [[]] * 4
            numbers = [pa.array([signed(v) for v in side], pa.int64()) for side in sides]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *numbers], NAMES)

    def seen(n: str, bits: str):
        places = F.bit_count(F.bit_or(bits))
        kinds = -64 * F.log1p(-F.least(places, F.lit(63)) / 64)
        return F.when(places < 48, F.least(F.sum(n), kinds)).otherwise(F.sum(n))

    sums = rows.select("text", "toxic").mapInArrow(run, EVIDENCE).groupBy("feature")
    tested = materialize(
        sums.agg(seen("n1", "bits1").alias("n1"), seen("n0", "bits0").alias("n0")).filter(F.col("n1") >= MIN_DOCS)
    )
    base = n1 / (n1 + n0)
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    rest = F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    ratio = 2 * (F.col("n1") * F.log(share / base) + rest)
    bar = max(MIN_Z**2, 2 * math.log(max(tested.count(), 1)))
    good = tested.filter((share > base) & (ratio >= bar)).select("feature")
    return [r["feature"] for r in good.orderBy("feature").collect()]


@dataclass
class Sparse:
    """A matrix by the rows, columns and values of what is not 0."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.columns], self.shape[0])

    def turned(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * v[self.rows], self.shape[1])


def solved(product, diagonal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Conjugate gradients with the diagonal as preconditioner."""
    x, rest = np.zeros_like(right), right.copy()
    near = rest / diagonal
    way, size = near.copy(), rest @ near
    least = SMALL**2 * size
    for _ in range(TURNS):
        if size <= least:
            break
        bent = product(way)
        step = size / (way @ bent)
        x += step * way
        rest -= step * bent
        near = rest / diagonal
        size, before = rest @ near, size
        way = near + size / before * way
    return x


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).sum())


def fit(x: Sparse, y: np.ndarray, strength: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; no weight is negative, so that no word excuses another.

    A step is halved until the penalised loss falls. Memory follows what is not 0 in the rows, however
    many features there are.
    """
    n = x.shape[1] + 1
    w, ridge = np.zeros(n), np.full(n, strength)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge[-1] = 1e-6
    squares = Sparse(x.rows, x.columns, x.values**2, x.shape)

    def objective(v: np.ndarray) -> float:
        return loss(x.times(v[:-1]) + v[-1], y) + float(ridge @ (v * v)) / 2

    at = objective(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -30, 30)))
        bend = p * (1 - p)
        slope = ridge * w + np.append(x.turned(p - y), (p - y).sum())
        free = (w > 0) | (slope < 0)
        free[-1] = True

        def product(v, bend=bend, free=free):
            v = np.where(free, v, 0.0)
            u = bend * (x.times(v[:-1]) + v[-1])
            return np.where(free, ridge * v + np.append(x.turned(u), u.sum()), 0.0)

        diagonal = ridge + np.append(squares.turned(bend), bend.sum())
        step = solved(product, diagonal, np.where(free, slope, 0.0))
        for halvings in range(20):
            tried = w - step / 2**halvings
            tried[:-1] = np.maximum(tried[:-1], 0)
            after = objective(tried)
            if after < at:
                break
        else:
            break
        gain, w, at = at - after, tried, after
        if gain < 1e-9 * max(at, 1.0):
            break
    return w[:-1], float(w[-1])


def chosen_fit(x: Sparse, y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, float]:
    """Fitted with the ridge that does best on texts left out of a first fit (``part`` is true)."""
    inner = np.flatnonzero(~part[x.rows])
    kept = Sparse(np.cumsum(~part)[x.rows[inner]] - 1, x.columns[inner], x.values[inner], (int((~part).sum()), x.shape[1]))
    best, least = RIDGES[0], math.inf
    for strength in RIDGES if part.any() and len(set(y[~part].tolist())) == 2 else ():
        w, b = fit(kept, y[~part], strength)
        left = loss((x.times(w) + b)[part], y[part])
        if left < least:
            best, least = strength, left
    return fit(x, y, best)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    A character model is counted over all texts. Tokens with leetspeak, separators, masked or spaced
    letters or long repeats are read as lattices, from which Viterbi takes the likeliest words. The
    classifier weighs words and word beginnings of the restored texts by number and density. It is
    fitted on labelled rows that are not held out, a hash sample of at most about ``SAMPLE_ROWS``, with
    as many toxic ones as there are up to half. Equal texts of the sample are one row, toxic if any is.

    Null and empty texts and texts without a known feature get the score of no evidence. A null id is
    scored like any other and has no label. Labels of one id are combined by the larger; null labels
    are left out. Without labels of both kinds every score is the share of toxic rows. Repeated rows
    are scored alike. Texts are read whole, however long. Other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    channel = Channel(character_model(docs, text))
    known = (
        labels.select(F.col(doc_id).cast("long").alias("__doc_id"), F.col(label).cast("int").alias("toxic"))
        .filter("__doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("__doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(F.crc32(F.encode(F.col("__doc_id").cast("string"), "UTF-8")) % 5 != 0)
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    keep1 = min(1.0, SAMPLE_ROWS / 2 / max(n1, 1))
    keep0 = min(1.0, (SAMPLE_ROWS - n1 * keep1) / max(n0, 1))
    place = F.pmod(F.xxhash64("__doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(place < F.when(F.col("toxic") == 1, keep1).otherwise(keep0))
    # as many ids as the sample has rows, which the parameter bounds; equal texts are one row of it
    sample = materialize(
        rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc_id"))
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    names = pick_features(sample, channel, n1, n0) if n1 and n0 else []
    wanted = {f: i for i, f in enumerate(names)}

    def known_in(count, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of a text: per feature its number, then its density."""
        size, found = count(text or "")
        numbers = np.array(sorted(found), np.int64)
        counts = np.array([found[i] for i in numbers.tolist()], np.float64)
        return np.concatenate([numbers, numbers + len(names)]), np.concatenate(values(size, counts))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counted(channel, wanted)
        for batch in batches:
            every = [known_in(count, t) for t in batch.column(0).to_pylist()]
            columns = pa.array([c.astype(np.int32).tobytes() for c, _ in every], pa.binary())
            packed = pa.array([v.astype(np.float32).tobytes() for _, v in every], pa.binary())
            part = pa.array([zlib.crc32((t or "").encode()) % CHOOSE == 0 for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([columns, packed, batch.column(1), part], ["columns", "x", "y", "part"])

    weights, bias = np.zeros(2 * len(names)), math.log((n1 + 0.5) / (n0 + 0.5))
    if names:
        fitted = sample.select("text", "toxic").mapInArrow(vectors, "columns binary, x binary, y int, part boolean").toPandas()
        # sums do not depend on the order in which tasks end
        fitted = fitted.sort_values(["y", "part", "columns", "x"])
        y = fitted["y"].to_numpy(np.float64)
        rows_of = np.repeat(np.arange(len(y)), [len(c) // 4 for c in fitted["columns"]])
        columns = np.frombuffer(b"".join(fitted.pop("columns")), np.int32)
        x = np.frombuffer(b"".join(fitted.pop("x")), np.float32).astype(np.float64)
        part = fitted["part"].to_numpy(bool)
        weights, bias = chosen_fit(Sparse(rows_of, columns, x, (len(y), 2 * len(names))), y, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counted(channel, wanted)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                every = [known_in(count, t) for t in batch.column(1).to_pylist()]
                sums = np.array([weights[c] @ v for c, v in every])
                scores = 1 / (1 + np.exp(-np.clip(sums + bias, -30, 30)))
                held = [held_out(i) for i in batch.column(0).to_pylist()]
                arrays = [batch.column(0), pa.array(held), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
