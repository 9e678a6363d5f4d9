import hashlib
import random

import numpy as np
import pytest
import xxhash

from feedloom.llm import substrings


def plain(rows, window=13):
    """Every window in a dictionary, on the input."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def some_rows():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "\U0001f600"]
    some = lambda n: rnd.choices(vocabulary, k=n)
    passages = [some(n) for n in (12, 13, 14, 30, 60, 200)]
    rows = []
    for i in range(120):
        parts = [some(rnd.randrange(0, 25))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), some(rnd.randrange(0, 9))]
        rows.append((rnd.randrange(1000) * 2 - 500, rnd.choice([" ", "\n", " \t"]).join(sum(parts, []))))
    hot = some(25)
    rows += [(2000 + i, " ".join(some(3) + hot + some(3))) for i in range(60)]
    rows += [(3000 + i, " ".join(passages[5])) for i in range(20)]  # copies
    rows += [(4000, "a " * 500), (4001, "a " * 12), (4002, "a " * 13), (4003, "b " + "a " * 40 + "c")]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "a " * 20), rows[3], (rows[4][0], rows[5][1])]
    return [*rows, (6000, " ".join(some(20_000)))]


@pytest.mark.parametrize("frequent", [False, True])
def test_matches_all_windows(spark, monkeypatch, frequent):
    if frequent:  # most anchors travel as single windows
        monkeypatch.setattr(substrings, "SAMPLE", 1)
        monkeypatch.setattr(substrings, "FREQUENT_LEAST", 2)
        monkeypatch.setattr(substrings, "FREQUENT_SHARE", 0.0)
    monkeypatch.setattr(substrings, "TOGETHER", 16)
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tag string, shard int")
    got = sorted(map(tuple, substrings.without_repeats(docs.repartition(5)).collect()), key=repr)
    assert got == plain(rows)


@pytest.mark.parametrize("window", [2, 5, 8])
def test_other_lengths_and_texts(spark, window):
    rows = [(i, t) for i, t in some_rows()[:90] if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.without_repeats(docs, window=window, texts=True).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == plain(rows, window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_hashes_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 500).astype(np.uint64)
    for length in (1, 2, 3, 7, 13, 16):
        hashes = substrings.window_hashes(words, length)
        again = np.concatenate([substrings.window_hashes(words[k : k + length], length) for k in range(500 - length + 1)])
        assert (hashes == again).all() and np.unique(hashes).size == hashes.size


def alike(n):
    """Pairs of words that agree in 16 bits of their hashes."""
    seen, out = {}, []
    for i in range(100_000):
        word = f"word{i}"
        key = xxhash.xxh64_intdigest(word.encode()) >> 48
        if key in seen:
            out.append((seen.pop(key), word))
        else:
            seen[key] = word
    return out[:n]


@pytest.mark.parametrize("together", [4, 1024])
def test_windows_that_differ_in_one_word_are_apart(spark, monkeypatch, together):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    rows = []
    for i, (one, other) in enumerate(alike(60)):
        passage = " ".join(f"p{i}x{k}" for k in range(12))
        rows += [(i, f"{passage} {one}"), (1000 + i, f"{passage} {other}"), (2000 + i, f"{passage} {one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substrings.without_repeats(docs).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("window", [16, 50, 150])
def test_long_windows(spark, window):
    rnd = random.Random(window)
    some = lambda n: [f"w{rnd.randrange(500)}" for _ in range(n)]
    passages = [some(n) for n in (window - 1, window, window + 1, 3 * window)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join([*some(rnd.randrange(20)), *rnd.choice(passages), *some(9), *rnd.choice(passages)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substrings.without_repeats(docs, window=window).collect()), key=repr) == plain(rows, window)
