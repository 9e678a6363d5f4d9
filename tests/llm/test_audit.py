import random
from itertools import permutations

import pytest

from feedloom.llm import audit

SCHEMA = "doc_id long, text string, lang string, failed int, n int"


def fails(rows):
    """Per row the letters of the filters it fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        own = "A" if len(words) < 200 else ""
        own += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        own += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
        own += "D" if set(text) & set("#$%&*|") else ""
        same = [i for i, t, _ in rows if i is not None and (t or "") == text]
        out.append(own + ("E" if doc_id is not None and doc_id > min(same) else ""))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), {}
    for part in {p or "" for *_, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                out[part, order, step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for x in "ABCDE":
            shapley = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == x:
                    v.append(shapley)
    return out


def sample():
    rnd = random.Random(3)
    texts = ["", None, "Only A Few", "x $ y", " ".join(f"w{i}" for i in range(230)), "same " * 250, "q " * 200_000]
    texts += [" ".join(rnd.choices([f"w{i}" for i in range(rnd.choice([30, 900]))], k=rnd.choice([150, 199, 200, 260]))) for _ in range(20)]
    texts += [t.upper() if rnd.random() < 0.4 else t + rnd.choice(["\n#", " ", "Ä"]) for t in texts[7:]]
    rows = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts * 2)]
    rnd.shuffle(rows)
    rows += [rows[0], (None, "Only A Few", "en"), (None, None, "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 70, 2)] + [(0, 1, 0), (None, 1, 1)]
    return rows, labels


def test_equals_applying_the_filters_in_every_order(spark):
    rows, labels = sample()
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == plain(rows, labels)


def test_potentials_share_out_the_game(spark):
    """Shapley values add up to what all filters remove together."""
    rnd = random.Random(1)
    counted = [("p", m, rnd.randrange(50), 0, 0) for m in range(32)]
    games = audit.removal_games(spark.createDataFrame(counted, "part string, failed int, n long, good long, toxic long"))
    row = games.withColumn("potential", audit.potentials(audit.F.col("n"))).first()
    shares = [row.potential[31] - 5 * row.potential[31 - (1 << k)] for k in range(5)]
    assert sum(shares) == 120 * sum(n for _, m, n, *_ in counted if m)


@pytest.mark.parametrize("n_labels", [0, 1])
def test_empty_tables(spark, n_labels):
    labels = spark.createDataFrame([(1, 1, 1)][:n_labels], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = audit.filter_audit(spark.createDataFrame([(1, None, None, 0, 0)], SCHEMA), labels)
    assert one.count() == 600 and {r.shapley for r in one.collect()} == {0, 120}
