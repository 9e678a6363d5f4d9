import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.llm import perplexity as ppl


def keyed(text):
    padded = [ppl.START] * 3 + [min(ord(c), ppl.CODES - 1) for c in text] + [ppl.END]
    return [tuple(padded[i : i + 4]) for i in range(len(padded) - 3)]


def plain_model(texts):
    """Counts and discounts in dictionaries; returns the probability of one n-gram."""
    counts, levels = Counter(g for t in texts if t for g in keyed(t)), []
    for order in range(4, 0, -1):
        of = Counter(min(n, 5) for n in counts.values())
        if of[1] and of[2] and of[3]:
            y = of[1] / (of[1] + 2 * of[2])
            raw = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3]]
            taken = [min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw)]
        else:
            taken = [0.5] * 3
        total, rest = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            rest[g[:-1]] += taken[min(n, 3) - 1]
        levels.append((dict(counts), taken, total, rest))
        if order > 1:
            counts = Counter(g[1:] for g in counts)

    def prob(gram):
        p = 1 / ppl.CODES
        for order in range(1, 5):
            counts, taken, total, rest = levels[4 - order]
            own = gram[4 - order :]
            if total.get(own[:-1]):
                n = counts.get(own, 0)
                left = n - taken[min(n, 3) - 1] if n else 0.0
                p = left / total[own[:-1]] + rest[own[:-1]] / total[own[:-1]] * p
        return p

    return prob


def some_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "\U0001f600 ok", None), (None, "the of", "xx"), rows[0]]
    labels = [(r[0], int(r[0] % 3 > 0)) for r in rows[:120] if r[0] is not None] + [(None, 1), (1, None), (9001, 1)]
    return (
        rows,
        labels,
        spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, gram string, role int"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


@pytest.mark.parametrize("broadcast", [True, False])
def test_matches_dictionaries(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ppl, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ppl, "GROUP_CHARS", 100_000)
    rows, labels, docs, table = some_tables(spark)
    got = ppl.perplexity_filter(docs, table, quantiles=(0.9,)).collect()
    assert len(got) == len(rows)
    ids = spark.createDataFrame([(r[0],) for r in rows if r[0] is not None], "i long").distinct()
    held = {r[0] for r in ids.filter(f"pmod(xxhash64(i), {ppl.HELD}) = 0").collect()}
    good = {i for i, q in labels if q == 1 and i is not None}
    prob = plain_model([t for i, t, _ in rows if i in good and i not in held])
    want = {}
    for i, t, lang in rows:
        keys = keyed(t) if t else []
        want[i] = (len(keys), math.exp(-sum(math.log(prob(k)) for k in keys) / len(keys)) if keys else None, lang)
    for r in got:
        n, value, lang = want[r.doc_id]
        assert r.n_chars == n and (r.perplexity is None) == (value is None)
        assert value is None or r.perplexity == pytest.approx(value, rel=1e-9)
        assert r.kept == (value is not None and r.perplexity <= r.threshold)
    limits = defaultdict(list)
    for i, t, lang in rows:
        if i in good and i in held and t:
            limits[lang].append(want[i][1])
    for r in got:
        own = sorted(limits.get(want[r.doc_id][2]) or sum(limits.values(), []))
        assert r.threshold == pytest.approx(own[math.ceil(0.9 * len(own)) - 1], rel=1e-9)


def test_separates_the_given_labels(spark):
    """On the rows that neither the counts nor the thresholds have seen, by language."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = ppl.perplexity_filter(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    unseen = scored.filter(f"quality = 0 AND pmod(xxhash64(doc_id), {ppl.HELD}) > 0")
    for r in unseen.groupBy("lang").agg(F.count_if(~F.col("kept")).alias("gone"), F.count("*").alias("n")).collect():
        assert r.gone >= 0.9 * r.n, r
    good = scored.filter("quality = 1").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).first()
    assert good.kept >= 0.98 * good.n


def test_the_filter_lets_all_ids_through_and_few_others(spark):
    ids = spark.range(0, 30_000, 3).select(F.col("id").alias("i"))
    rows = spark.range(-10, 30_000).select(F.when(F.col("id") >= 0, F.col("id")).alias("k"), F.lit("x" * 50).alias("text"))
    got = [r.k for r in ppl.maybe_in(rows, ids, "k").collect()]
    assert set(range(0, 30_000, 3)) <= set(got) and len(got) < 10_000 * 1.05 and None not in got
    assert ppl.maybe_in(rows, ids.limit(0), "k").count() == 0


def test_thresholds_part_both_kinds(spark):
    held = [("a", 2, float(i)) for i in range(1000)] + [("a", 3, 991.5)] * 50 + [("b", 2, float(i)) for i in range(1000)]
    held += [("c", 3, 1.0)]
    table = spark.createDataFrame(held, "k string, role int, perplexity double")
    assert {r.k: r.threshold for r in ppl.thresholds(table, "k").collect()} == {"a": 989.0, "b": 998.0}


def test_empty_tables(spark):
    rows, _, docs, table = some_tables(spark)
    assert ppl.perplexity_filter(docs.limit(0), table).count() == 0
    got = ppl.perplexity_filter(docs, table.limit(0)).collect()
    assert all(r.kept == bool(r.n_chars) and r.threshold == math.inf for r in got)
