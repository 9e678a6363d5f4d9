from collections import Counter

import pytest

from feedloom.llm.mixing import mix_sources, mixed_documents


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, s, "other", 7.0) for i, t, s in rows], "doc_id long, text string, source string, key string, size double"
    )


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


ROWS = (
    [(i, "w " * (i % 40), "hot") for i in range(300)]
    + [(1000 + i, "a b\tc", f"s{i % 7}") for i in range(80)]
    + [(2000 + i, "x y z", None) for i in range(9)]
    + [(3000, None, "s1"), (3001, "", "empty"), (None, "p q r", "s2"), (None, "p q r", "s2"), (1000, "a b\tc", "s0")]
    + [(4000, "long " * 3000, "\U0001f600"), (4001, "short one", "￿")]
)


def test_targets_and_taken_words(spark):
    got = mix_sources(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    targets = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, target in targets.items():
        assert taken[s] == int(target + 1e-9)
        epochs = taken[s] // sizes[s] if sizes[s] else 0
        cut = [r for r in got if r.source == s and r.size and r.taken not in (epochs * r.size, (epochs + 1) * r.size)]
        assert len(cut) <= 1


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark, ROWS)
    first = sorted(map(tuple, mix_sources(docs).collect()), key=repr)
    assert first == sorted(map(tuple, mix_sources(docs.repartition(5)).collect()), key=repr)


def test_documents_come_as_often_as_taken(spark):
    docs = documents(spark, ROWS)
    want = Counter()
    for r in mix_sources(docs).collect():
        if r.taken:
            want[r.doc_id] += -(-r.taken // r.size)
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == want


def test_empty_table_and_texts(spark):
    assert mix_sources(documents(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(documents(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
