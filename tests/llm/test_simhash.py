import random
import re

import numpy as np
import pytest
import xxhash

from feedloom.llm import simhash
from feedloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, shingle=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(rows, max_bits=3, shingle=3):
    """(doc_id, fingerprint, component) by comparing every pair."""
    prints = [plain_print(t, shingle) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return out


def texts():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["Äther", "naïve", " x"]
    rows = []
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 4, 60, 120]))
        rows.append(" ".join(words))
        for _ in range(rnd.randrange(4)):
            edited = list(words)
            edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            rows.append("\t ".join(edited).upper() if rnd.random() < 0.3 else "\n".join(edited))
    return [*rows, "", None, " \x0b\x0c", "w1", "W1", rows[0], "x " * 70_000]


def canonical(rows):
    return sorted(map(tuple, rows), key=repr)


def test_matches_all_pairs(spark):
    rows = list(enumerate(texts())) + [(None, "w1"), (None, "alone here now"), (3, texts()[3])]
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int"
    )
    assert canonical(simhash.near_duplicates(docs).collect()) == canonical(plain_components(rows))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [2, 50])
def test_large_blocks_are_cut_without_losing_links(spark, limit):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = {base}
    for _ in range(150):
        x = int(rng.choice(list(prints)))
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    edges = simhash.linked_pairs(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 3, limit)
    found = {r.node: r.root for r in components(edges, "a", "b").collect()}
    root = {p: p for p in prints}
    for x in prints:
        for y in prints:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                low, high = sorted((root[x], root[y]))
                root = {p: low if r == high else r for p, r in root.items()}
    assert {p: found.get(p, p) for p in prints} == root


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200 + i, 200) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(101)} | {200 + i: 200 for i in range(50)}


def test_one_document_of_each_group_stays(spark):
    rows = [(i + 3, t) for i, t in enumerate(texts())] + [(None, "w1"), (None, "alone here now"), (4, texts()[1])]
    rows += [(None, "alone here  now")]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, root string, __n long")
    out = simhash.unique_documents(docs)
    assert out.columns == docs.columns
    assert all(r["__n"] == r.doc_id for r in out.collect())
    component = {r[0]: r[2] for r in plain_components(rows) if r[0] is not None}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(component.values()))
    assert got.count(None) == 1
