import math
import re
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from feedloom.operators.language import languages_of, train_languages, trigrams, with_language
from feedloom.operators.novelty import novelty, sketch

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_trigrams(column):
    got = column(trigrams, ["Ab 1c!", "Ä\nb", "x"])
    assert got == [[" ab", "ab ", "b c", " c "], [" ä ", "ä b", " b "], [" x "]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS)
    model = train_languages(docs.filter("doc_id % 5 <> 0"))
    assert model.languages == ["de", "en", "es", "fr"] and model.grams.count() <= 4000
    learned = docs.filter("doc_id % 5 <> 0").select("text").distinct()
    unseen = docs.filter("doc_id % 5 = 0").join(learned, "text", "left_anti").filter(F.length(F.trim("text")) > 0)
    found = with_language(unseen.withColumnRenamed("lang", "true"), model, "doc_id")
    right, total = found.agg(F.count_if(F.col("true") == F.col("language")), F.count("*")).first()
    assert total > 150 and right / total > 0.98


def test_language_of_odd_rows(spark):
    rows = [("the the the", "en"), ("der der der", "de"), (None, "en"), ("x", None), ("", "fr")] + [("the cat", "en")] * 50
    labelled = spark.createDataFrame(rows, "text string, lang string")
    model = train_languages(labelled, min_texts=1)
    assert model.languages == ["de", "en", "fr"]
    texts = [(1, "the", "a"), (2, "DER", "b"), (3, None, "c"), (4, "", "d"), (5, "12 3", "e"), (6, "日本語", "f"), (7, "the der " * 5000 + "the", "g")]
    asked = spark.createDataFrame(texts, "id int, text string, language string")
    got = {r.id: r.language for r in with_language(asked, model).collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: None, 7: got[7]} and got[7] in ("en", "de")
    assert with_language(asked, model).columns == ["id", "text", "language"]
    assert with_language(asked.limit(0), model).count() == 0
    nothing = train_languages(labelled.limit(0))
    assert nothing.languages == [] and languages_of(asked, nothing).count() == 0
    assert {r.language for r in with_language(asked, nothing).collect()} == {None}
    # copies are one text: fifty of them do not change the model
    once = train_languages(labelled.dropDuplicates(), min_texts=1)
    assert sorted(map(tuple, once.grams.collect())) == sorted(map(tuple, model.grams.collect()))


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def test_novelty_over_batches_is_near_that_of_all_shingles(spark):
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text").filter("doc_id < 300")
    index = spark.createDataFrame([], "key string")
    got = {}
    for low in range(0, 300, 100):
        part = docs.filter(F.col("doc_id").between(low, low + 99))
        found, added = novelty(part, index, F.col("doc_id"), "doc_id")
        got |= {r.doc_id: r for r in found.collect()}
        index = index.unionByName(added)
    assert index.count() == index.distinct().count()
    seen, wrong, checked = set(), 0, 0
    for row in docs.orderBy("doc_id").collect():
        own = shingles(row.text)
        kept = {h for h in (md5(s.encode()).hexdigest()[:16] for s in own) if h < "4"}
        sketched = got[row.doc_id]
        assert sketched.n_sketch == len(kept)
        if kept:
            exact = len(own - seen) / len(own)
            checked += 1
            # two standard errors, which chance alone exceeds now and then
            wrong += abs(float(sketched.novelty) - exact) > 1 / math.sqrt(len(kept)) + 0.001
        else:
            assert sketched.novelty is None
        seen |= own
    assert checked > 250 and wrong <= checked * 0.05


def test_novelty_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, 5, text), (2, 4, text), (3, 6, text + " " + text), (4, 1, None), (5, 1, ""), (6, 1, "!!"), (7, 9, "One two THREE")]
    df = spark.createDataFrame(rows, "id int, at int, text string")
    found, added = novelty(df, spark.createDataFrame([], "key string"), F.col("at"))
    got = {r.id: (r.n_new, r.novelty) for r in found.collect()}
    # the earliest of equal texts is new, at one time the one with the smaller id
    assert float(got[2][1]) == 1 and float(got[1][1]) == 0 and float(got[3][1]) < 0.05
    assert got[4] == got[5] == got[6] == (0, None)
    again, nothing = novelty(df, added, F.col("at"))
    assert nothing.count() == 0 and {r.n_new for r in again.collect()} == {0}
    assert novelty(df.limit(0), added, F.col("at"))[0].count() == 0


def test_a_sketch_is_the_same_in_every_text(column):
    short, long = column(sketch, ["alpha beta gamma delta", "x y alpha beta gamma delta z " * 50])
    assert set(short) <= set(long) and len(long) == len(set(long))
    counts = defaultdict(int, Counter(k[0] for k in long))
    assert set(counts) <= set("0123")
