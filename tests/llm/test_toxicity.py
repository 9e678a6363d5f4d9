import random
import zlib

import numpy as np
import pytest

from feedloom.llm import toxicity as tox

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return tox.character_model(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "text")


def test_character_counts_are_all_runs():
    texts = ["Ab, c\n  é1z", "", "a"]
    symbols = [0, 0, 0]
    for word in " ".join(texts).lower().replace(",", " ").replace("1", " ").split():
        symbols += [tox.symbol(c) for c in word] + [0]
    want = np.zeros(tox.SYMBOLS**tox.ORDER, int)
    for i in range(len(symbols) - tox.ORDER + 1):
        want[sum(s * tox.SYMBOLS ** (tox.ORDER - 1 - k) for k, s in enumerate(symbols[i : i + tox.ORDER]))] += 1
    assert (tox.character_counts(texts, tox._classes()) == want).all()


def test_costs_are_distributions(model):
    assert np.allclose(np.exp(-model).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize(
    "text",
    [
        "1d10t", "!d!ot", "i d i o t", "i.d.i.o.t", "i-d-i-o-t", "id!ooot", "iiidiooot", "IDIOT!!", "«idiot»", "i_d_i_0_t",
        "(idiot)", "1 d 1 0 t", "idiooooot",
    ],
)
def test_disguised_words_are_restored(model, text):
    assert tox.Channel(model).restored(text) == ["idiot"]


def test_best_path_is_the_best_of_all(model, monkeypatch):
    """The beam finds what trying every reading finds."""
    channel = tox.Channel(model)

    def cost(text):
        state = total = 0
        for char in text:
            s = 0 if char == " " else tox.symbol(char)
            if s == 0 and state % tox.SYMBOLS == 0:
                continue
            total += model[state, s]
            state = (state * tox.SYMBOLS + s) % tox.CONTEXTS
        return total

    for token in ("l0s3r", "m0r0n", "tr@sh", "5tup1d", "cl0wn", "$cum", "w0rthl355", "p4th3tic", "th3 re"):
        every = [("", 0.0)]
        for options in channel.readings(token):
            every = [(t + o, c + e) for t, c in every for o, e in options]
        want = min(every, key=lambda x: (x[1] + cost(x[0] + " "), x[0] + " "))[0].split()
        assert channel.decode(token) == want


def test_plain_text_stays(model):
    text = "Thon ofer, (and) the-re été 12 34.5 ... naïve"
    assert tox.Channel(model).restored(text)[:3] == ["thon", "ofer", "and"]
    assert "été" in tox.Channel(model).restored(text) and "naïve" in tox.Channel(model).restored(text)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = tox.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic, clean = (np.sort(held[held["toxic"] == k]["score"].to_numpy()) for k in (1, 0))
    less, equal = np.searchsorted(clean, toxic, "left"), np.searchsorted(clean, toxic, "right")
    assert (less + equal).sum() / 2 / len(toxic) / len(clean) > 0.95
    assert (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.02


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate([f"the and of n{i}" for i in range(40)] + [f"m{i} you loser k{i} the" for i in range(20)])]
    rows += [(100, None, "x"), (101, "", "x"), (None, "you l0ser", "x"), (0, "the and of n0", "x"), (102, "l " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = [(i, int(i >= 40), "l") for i in range(60)] + [(None, 1, "l"), (3, None, "l"), (45, 0, "l")]
    schema = "doc_id long, toxic int, text string"
    got = tox.toxicity(docs, spark.createDataFrame(labels, schema)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert {r.predicted for r in got if r.doc_id in (0, 100, 101, 102)} == {0}
    none = spark.createDataFrame([], schema)
    assert {r.score for r in tox.toxicity(docs, none).collect()} == {0.5}
    assert tox.toxicity(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_long_runs_are_decoded_in_one_pass(model):
    channel = tox.Channel(model)
    assert channel.restored("i d i o t " * 20 + ".") == ["idiot"] * 20
    assert channel.restored("1d10t-" * 30) == ["idiot"] * 30


def test_no_path_is_lost(model):
    channel = tox.Channel(model)
    rnd = random.Random(4)

    def cost(text):
        state = total = 0
        for char in text:
            s = 0 if char == " " else tox.symbol(char)
            if s or state % tox.SYMBOLS:
                total += float(model[state, s])
                state = (state * tox.SYMBOLS + s) % tox.CONTEXTS
        return total

    for _ in range(20):
        lattice = channel.readings("".join(rnd.choices("1|!0$a(+", k=6)))
        every = [("", 0.0)]
        for options in lattice:
            every = [(t + o, c + e) for t, c in every for o, e in options]
        assert channel.best(lattice)[0] == pytest.approx(min(c + cost(t + " ") for t, c in every), abs=1e-4)


def test_letterless_doubled_and_edge_disguises_are_read(model):
    counts = tox.character_counts(["ass twit shit and the"] * 2000, tox._classes())
    channel = tox.Channel(tox.costs(counts.astype(float)))
    for token, word in [("@$$", "ass"), ("455", "ass"), ("@ $ $", "ass"), ("4 5 5", "ass"), ("sh!+", "shit"), ("+w1t", "twit")]:
        assert channel.restored(token) == [word], token
    assert channel.restored("2019 34.5 - - - 1 2 3 ...") == []
    assert channel.restored("(and) the! the+") == ["and", "the", "the"]
    assert tox.Channel(model).restored("iiddiioott") == ["idiot"]


def test_every_word_that_stands_out_is_weighed(spark):
    rnd = random.Random(6)
    toxic = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 8)) for _ in range(150)]
    rows = [(i, "the and of " + " ".join(rnd.sample(toxic, 4))) for i in range(1200)]
    rows += [(2000 + i, f"the and of on the n{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _ in rows], "doc_id long, toxic int")
    alone = spark.createDataFrame([(5000 + i, f"the and of on {w}") for i, w in enumerate(toxic)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in tox.toxicity(docs.unionByName(alone), labels).collect()}
    clean = max(s for i, s in scores.items() if 2000 <= i < 5000)
    assert min(s for i, s in scores.items() if i >= 5000) > clean


def test_copies_are_not_evidence(spark):
    """Labelled texts that come 20 times, some with an edit, do not drown the words that make them toxic."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()[["doc_id", "text"]]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    rnd = random.Random(2)
    learned = docs.merge(labels, on="doc_id")
    learned = learned[[zlib.crc32(str(i).encode()) % 5 != 0 for i in learned["doc_id"]]]
    rows, marks, fresh = [tuple(r) for r in docs.itertuples(index=False)], [tuple(r) for r in labels[["doc_id", "toxic"]].itertuples(index=False)], 10**6
    for r in learned[learned["doc_id"] % 4 < 2].itertuples(index=False):
        for _ in range(20 if r.toxic else 4):
            words = r.text.split(" ")
            words[rnd.randrange(len(words))] = "edit"
            rows.append((fresh, r.text if rnd.random() < 0.5 else " ".join(words)))
            marks.append((fresh, int(r.toxic)))
            fresh += 1
    scored = tox.toxicity(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    ).toPandas()
    held = scored[scored["held_out"] & (scored["doc_id"] < 10**6)].merge(labels, on="doc_id").merge(docs, on="doc_id")
    held = held[~held["text"].isin(set(learned["text"]))]
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.85 and held[held["toxic"] == 0]["predicted"].mean() < 0.02


def test_masked_letters(model):
    channel = tox.Channel(model)
    for token in ("i*iot", "id#ot", "i_iot", "idi*t", "id**t", "i*i*t"):
        assert channel.restored(token) == ["idiot"], token
    assert channel.restored("**** ____ ## (a) *b*") == ["a", "b"]


def test_the_fit_does_not_run_away(spark):
    """Rows that one feature parts without an error still give finite weights."""
    x = tox.Sparse(np.arange(200), np.zeros(200, int), np.repeat([1.0, 0.0], 100), (200, 1))
    for strength in tox.RIDGES:
        w, b = tox.fit(x, np.repeat([1.0, 0.0], 100), strength)
        assert 0 < w[0] < 100 and -50 < b < 0
