import numpy as np

from feedloom.llm import vectors


def plain(rows, least=0.98):
    """All pairs in double precision."""
    good, units = [], []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        good.append(k)
        x = np.array(v, float) / np.abs(v).max()
        units.append(x / np.linalg.norm(x))
    links = {k: [] for k in range(len(rows))}
    for a, x in zip(good, units, strict=True):
        for b, y in zip(good, units, strict=True):
            if a != b and rows[a][2] == rows[b][2] and x.size == y.size and float(x @ y) >= least:
                links[a].append(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        component = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(links[k]), component, i is not None and i == component))
    return sorted(out, key=repr)


def some_rows():
    rng = np.random.default_rng(6)
    rows, number = [], 0

    def add(v, label):
        nonlocal number
        rows.append((1000 - number, [None if x is None else float(x) for x in v] if v is not None else None, label))
        number += 1

    for label in (0, 1):
        for _ in range(40):
            center = rng.normal(size=16)
            center /= np.linalg.norm(center)
            for _ in range(rng.integers(1, 6)):
                noise = rng.normal(size=16)
                add(center + noise / np.linalg.norm(noise) * rng.choice([0.0, 0.1, 0.15, 0.2, 0.25]), label)
        chain = np.zeros(16)
        for step in range(12):
            chain = np.cos(step * 0.19) * np.eye(16)[0] + np.sin(step * 0.19) * np.eye(16)[1]
            add(chain, label)
    for _ in range(5):
        add(np.ones(16), 2)
    add(7 * np.ones(16), 2)
    add(1e300 * np.ones(16), 2)
    for bad in (None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15):
        add(bad, 2)
    add(np.ones(16), None)
    add([1.0, 1.0], 2)
    add([1.0, 1.01], 2)
    add([2.0], 2)
    rows.append((None, [1.0] * 16, 2))
    rows.append(rows[0])
    return rows


def table(spark, rows):
    return spark.createDataFrame(
        [(i, v, label, "n") for i, v, label in rows], "vec_id long, embedding array<double>, label int, node string"
    )


def test_matches_all_pairs(spark):
    rows = some_rows()
    got = sorted(map(tuple, vectors.near_vectors(table(spark, rows)).collect()), key=repr)
    assert got == plain(rows)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 30)
    rows = some_rows()
    got = sorted(map(tuple, vectors.near_vectors(table(spark, rows)).collect()), key=repr)
    assert got == plain(rows)


def test_recall_on_the_given_vectors_with_near_copies(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    rng, rows = np.random.default_rng(2), []
    for v, label in zip(data["embedding"], data["label"], strict=True):
        for distance in (0.0, 0.08, 0.12, 0.16, 0.22):
            noise = rng.normal(size=v.size)
            near = v + noise / np.linalg.norm(noise) * distance
            rows.append((len(rows), near.astype(np.float32).tolist(), int(label)))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(docs).collect()}
    want = {}
    for label in set(data["label"]):
        own = [r for r in rows if r[2] == label]
        units = np.array([np.float32(r[1]) for r in own]).astype(float)
        units /= np.linalg.norm(units, axis=1)[:, None]
        counts = ((units @ units.T) >= 0.98).sum(1) - 1
        want |= dict(zip([r[0] for r in own], counts.tolist(), strict=True))
    assert sum(min(got[i], n) for i, n in want.items()) >= 0.9 * sum(want.values()) > 0
    assert got == want


def test_empty_table(spark):
    assert vectors.near_vectors(table(spark, [])).count() == 0
