"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Segments whose pieces a task remembers before it starts anew, and the longest segment in bytes
# that is searched together with others.
REMEMBERED, LONGEST = 400_000, 48
# An unknown character costs this much more than the least likely piece.
UNKNOWN_PENALTY = 10.0
# Shift of Zipf's law for models that give ranks instead of log scores.
ZIPF_SHIFT = 2.7
ROWS_OUT = 256
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # fixed values of the model file's piece types
UNKNOWN_TEXT = " ⁇ "  # fixed value, what an unknown piece shows
BPE = 2  # fixed value of the model file's model types


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            if tag & 7 == 2:
                size, at = varint(at)
            else:
                size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """A vocabulary: texts, log scores and types by id, as read from a model file."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool


def read_model(path: str) -> Pieces:
    """Read a model file on the driver.

    A unigram model has log scores. A BPE model has merge ranks, which Zipf's law turns into log
    scores: the piece of rank r is as likely as 1 / (r + ``ZIPF_SHIFT``).
    """
    with open(path, "rb") as file:
        top = list(_fields(file.read()))
    texts, scores, kinds = [], [], []
    for number, value in top:
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            kinds.append(piece.get(3, NORMAL))
    trainer = dict(_fields(dict(top).get(2, b"")))
    normalizer = dict(_fields(dict(top).get(3, b"")))
    if normalizer.get(1, b"identity") != b"identity" or normalizer.get(4, 1):
        raise ValueError("only models that keep the text as it is are supported")
    if trainer.get(3) == BPE:
        scores = zipf_scores(scores, kinds)
    return Pieces(texts, scores, kinds, bool(normalizer.get(3, 1)))


def zipf_scores(scores: list[float], kinds: list[int]) -> list[float]:
    own = [1 / (ZIPF_SHIFT - s) if k == NORMAL else 0.0 for s, k in zip(scores, kinds, strict=True)]
    total = sum(own)
    # as exact as the model file's numbers
    return [float(np.float32(math.log(x / total))) if x else 0.0 for x in own]


@dataclass
class DoubleArray:
    """Child of ``node`` by byte ``b`` is ``base[node] + b`` if ``check`` there is ``node``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for key, number in keys.items():
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[None] = number
        size, free = 1 << 16, 1
        base, value = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        check = np.full(size, -1, np.int32)
        check[0] = -2
        todo = [(root, 0)]
        for node, at in todo:
            value[at] = node.get(None, -1)
            labels = np.array(sorted(b for b in node if b is not None), np.int64)
            if not labels.size:
                continue
            start = None
            while start is None:
                # first place from here on where all children find a free cell
                if free + 8192 > size:
                    base, value = np.pad(base, (0, size)), np.pad(value, (0, size), constant_values=-1)
                    check, size = np.pad(check, (0, size), constant_values=-1), 2 * size
                open_cells = check[free : free + 4096 + 256] == -1
                fits = np.logical_and.reduce([open_cells[b : b + 4096] for b in labels])
                first = int(fits.argmax())
                if fits[first]:
                    start = free + first
                else:
                    free += 2048
            base[at] = start
            check[start + labels] = at
            todo += [(node[int(b)], start + int(b)) for b in labels]
        used = int(np.flatnonzero(check != -1).max()) + 257
        return cls(base[:used].copy(), check[:used].copy(), value[:used].copy())


class Encoder:
    """Best sequence of pieces by the sum of log scores."""

    def __init__(self, pieces: Pieces):
        normal = [(i, t) for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == NORMAL]
        # a space stands for the white-space mark inside
        self.trie = DoubleArray.build({t.replace(MARK, " ").encode(): i for i, t in normal if t})
        self.lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.scores, self.costs, self.prefix = pieces.scores, np.array(pieces.scores), pieces.prefix
        self.unknown = min(pieces.scores[i] for i, _ in normal) - UNKNOWN_PENALTY
        self.unknown_id = pieces.kinds.index(UNKNOWN)
        self.bytes = [None] * 256
        for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
        self.fallback = None not in self.bytes
        # with no piece that goes on after a word into white space, words are independent
        apart = not any(re.search(f"[^{MARK}]{MARK}", t) for _, t in normal)
        self.segment = re.compile(r" +[^ ]*|[^ ]+" if apart else r"(?s).+")

    def viterbi(self, data: bytes) -> list[int]:
        """Ids of one segment; ``data`` is UTF-8 with spaces as marks."""
        base, check, value = self.lists
        scores, n, lowest = self.scores, len(data), -math.inf
        best, back, piece = [lowest] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == lowest:
                continue
            first = data[at]
            char = at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            node, single = 0, False
            for end in range(at, n):
                child = base[node] + data[end]
                if check[child] != node:
                    break
                node, found = child, value[child]
                if found >= 0:
                    total = here + scores[found]
                    if total > best[end + 1]:
                        best[end + 1], back[end + 1], piece[end + 1] = total, at, found
                    single = single or end + 1 == char
            if not single and here + self.unknown > best[char]:
                best[char], back[char], piece[char] = here + self.unknown, at, -1
        out: list[int] = []
        at = n
        while at:
            start = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.fallback:
                out.extend(self.bytes[b] for b in reversed(data[start:at]))
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
            at = start
        out.reverse()
        return out

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments one after the other, and how many each has.

        One step of the search is taken for all segments at once. Long segments and those whose best
        path has an unknown character go through the search one by one.
        """
        datas = [s.encode() for s in segments]
        lens = np.fromiter(map(len, datas), np.int64, len(datas))
        short = np.flatnonzero(lens <= LONGEST)
        paths: list = [None] * len(datas)
        sizes = np.zeros(len(datas), np.int64)
        if short.size:
            self._search([datas[i] for i in short.tolist()], short, paths, sizes)
        for i, path in enumerate(paths):
            if path is None:
                paths[i] = np.array(self.viterbi(datas[i]), np.int32)
                sizes[i] = len(paths[i])
        return np.concatenate(paths) if paths else np.zeros(0, np.int32), sizes

    def _search(self, datas: list[bytes], places: np.ndarray, paths: list, sizes: np.ndarray) -> None:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        width = max(map(len, datas))
        chars = np.array([d.ljust(width, b"\0") for d in datas], f"S{width}").view(np.uint8).reshape(len(datas), width)
        lens = np.fromiter(map(len, datas), np.int64, len(datas))
        best = np.full((len(datas), width + 1), -np.inf)
        back, piece = np.zeros(best.shape, np.int16), np.full(best.shape, -1, np.int32)
        best[:, 0] = 0.0
        for at in range(width):
            rows = np.flatnonzero((lens > at) & (best[:, at] > -np.inf))
            if not rows.size:
                continue
            lead = chars[rows, at]
            after = at + 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
            single = np.zeros(rows.size, bool)
            here, node, live = best[rows, at], np.zeros(rows.size, np.int64), np.arange(rows.size)
            for end in range(at, width):
                child = base[node] + chars[rows[live], end].astype(np.int64)
                on = (check[child] == node) & (lens[rows[live]] > end)
                live, node = live[on], child[on]
                if not live.size:
                    break
                found = value[node]
                hit = np.flatnonzero(found >= 0)
                own, ids = live[hit], found[hit]
                total = here[own] + self.costs[ids]
                better = total > best[rows[own], end + 1]
                r = rows[own[better]]
                best[r, end + 1], back[r, end + 1], piece[r, end + 1] = total[better], at, ids[better]
                single[own[after[own] == end + 1]] = True
            lone = np.flatnonzero(~single)
            total, r, to = here[lone] + self.unknown, rows[lone], after[lone]
            better = total > best[r, to]
            r, to = r[better], to[better]
            best[r, to], back[r, to], piece[r, to] = total[better], at, -1
        # walk back from the ends; -2 marks what is past the start
        at, steps, known = lens.copy(), [], np.ones(len(datas), bool)
        every = np.arange(len(datas))
        while at.any():
            step = np.where(at > 0, piece[every, at], -2)
            known &= step != -1
            steps.append(step)
            at = np.where(at > 0, back[every, at], 0)
        walked = np.array(steps[::-1]).T
        for i, place, fine in zip(range(len(datas)), places.tolist(), known.tolist(), strict=True):
            if fine:
                row = walked[i]
                paths[place] = row[row >= 0]
                sizes[place] = paths[place].size

    def encoder(self):
        """A function from texts to ids, one after the other, and how many each text has.

        It remembers the segments it has seen, up to ``REMEMBERED`` of them.
        """
        numbers: dict[str, int] = {}
        flat, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal flat, sizes
            if len(numbers) > REMEMBERED:
                numbers.clear()
                flat, sizes = flat[:0], sizes[:0]
            known, order, counts = len(numbers), [], []
            for text in texts:
                text = text.replace(MARK, " ")
                segments = self.segment.findall(" " + text if self.prefix and text else text)
                order += [numbers.setdefault(s, len(numbers)) for s in segments]
                counts.append(len(segments))
            if len(numbers) > known:
                ids, more = self.encode_segments(list(islice(numbers, known, None)))
                flat, sizes = np.concatenate([flat, ids]), np.concatenate([sizes, more])
            picked = np.array(order, np.int64)
            starts = np.cumsum(sizes) - sizes
            own = sizes[picked]
            ends = np.cumsum(own)
            shift = np.repeat(starts[picked] - (ends - own), own)
            of_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
            return flat[shift + np.arange(shift.size)], np.diff(of_text)

        return encode


class Decoder:
    """Text of ids: marks become spaces, runs of byte pieces are read as UTF-8."""

    def __init__(self, pieces: Pieces):
        self.prefix = pieces.prefix
        self.data = []
        for t, k in zip(pieces.texts, pieces.kinds, strict=True):
            if k == BYTE:
                self.data.append(bytes([int(t[3:5], 16)]))
            else:
                shown = {NORMAL: t.replace(MARK, " "), UNKNOWN: UNKNOWN_TEXT}
                self.data.append(shown.get(k, "").encode())

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.data[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def encode_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, *keep, tokens, n_tokens, n_bytes, round_trip), one row per input row.

    ``tokens`` is the most likely sequence of pieces; characters without a piece become byte pieces,
    ``n_bytes`` of them. ``round_trip`` says that decoding gives the text back, which holds unless
    the text has the white-space mark itself. The vocabulary is read on the driver and goes to the
    tasks as a trie whose size the vocabulary fixes.

    Null and empty texts have no tokens and count as a round trip; repeated rows and null ids are
    returned as they came. Only the named columns are read, whatever else there is. An empty table
    gives an empty result.
    """
    pieces = read_model(model)
    coder, decoder = Encoder(pieces), Decoder(pieces)
    is_byte = np.array([k == BYTE for k in pieces.kinds]).astype(np.int64)
    names = [doc_id, *keep]
    carried = [docs.schema[c] for c in names]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in carried]
        + ["tokens array<int>", "n_tokens long", "n_bytes long", "round_trip boolean"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder.encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                texts = [t.as_py() or "" for t in batch.column(len(names))]
                flat, sizes = encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = [flat[i:j].tolist() for i, j in pairwise(offsets.tolist())]
                fallen = np.concatenate([[0], np.cumsum(is_byte[flat])])[offsets]
                exact = [decoder.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                arrays = [
                    *batch.columns[: len(names)],
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                    pa.array(sizes),
                    pa.array(np.diff(fallen)),
                    pa.array(exact, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "tokens", "n_tokens", "n_bytes", "round_trip"])

    narrow = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("__text"))
    return narrow.mapInArrow(run, schema)


def decoded(tokens: Column, model: str = MODEL) -> Column:
    """The text of an array of ids; null stays null."""
    decoder = Decoder(read_model(model))

    @F.pandas_udf("string")
    def decode(ids):
        return ids.map(lambda x: None if x is None else decoder.decode(list(x)))

    return decode(tokens)
