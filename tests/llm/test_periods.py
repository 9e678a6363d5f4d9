import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from feedloom.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words):
    """Every lag, every place; the first period of a stretch is its smallest."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def nested(rnd, depth):
    """Words with repeats inside repeats, whole and cut."""
    if depth == 0:
        return rnd.choices("abcdefgh"[: rnd.choice([1, 2, 3, 8])], k=rnd.randrange(1, 9))
    out = []
    for _ in range(rnd.randrange(1, 4)):
        part = nested(rnd, depth - 1)
        out += part * rnd.choice([1, 1, 3, 4, 5, 9]) + part[: rnd.randrange(len(part) + 1)]
    return out[:2000]


@pytest.mark.parametrize("scan", [4, 16, 64])
def test_runs_equal_all_lags(monkeypatch, scan):
    """Small scan limits bring the minimizers to periods that brute force can check."""
    monkeypatch.setattr(periods, "SCAN", scan)
    rnd = random.Random(scan)
    texts = [nested(rnd, rnd.choice([1, 2, 3, 4])) for _ in range(40)]
    for period in (5, 70, 300):
        texts.append(rnd.choices("abc", k=20) + rnd.choices("abcdefgh", k=period) * 5 + rnd.choices("abc", k=20))
        texts.append((["a"] * (period - 1) + ["b"]) * 6)
    texts += [["a"] * 2000, [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 6]
    got = periods.measured([[w.encode() for w in t] for t in texts])
    assert got == [all_runs(t) for t in texts]


def test_query_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = [" ".join(nested(rnd, 3)) for _ in range(60)] + [" ".join(f"w{rnd.randrange(40)}" for _ in range(k)) for k in (0, 1, 30, 900, 3000)]
    texts += ["", None, " \x0b\x1c\n", "é é é é é é\té", "one two " * 400]
    rows = list(enumerate(texts)) + [(None, "x " * 9), (3, texts[3]), (3, texts[3]), (-5, texts[4])]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, start int, n_runs string").repartition(3)
    got = sorted(map(tuple, periods.periodic_runs(docs).collect()), key=repr)
    assert got == sorted((plain(i, t) for i, t in rows), key=repr)
    assert sum(r[1] for r in got) > 100 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_very_long_text_and_empty_table(spark):
    body = " ".join(f"w{i}" for i in range(50_000))
    row = periods.periodic_runs(spark.createDataFrame([(1, f"{body} " * 5)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 250_000, 50_000)
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
