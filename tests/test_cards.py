import json

from pyspark.sql import functions as F

from feedloom.functions import cards
from feedloom.functions.payload import first_scalar, is_filled
from feedloom.functions.scoring import READ_NOW_MIN
from feedloom.operators.analyze import analyze_items
from feedloom.operators.feedback import MALFORMED, MISSING, UNKNOWN_ACTION, feedback_fields

ITEM = "id int, title string, summary string, reason string, source_name string, importance_score double, canonical_url string"
LINKS = (
    '<p>Article URL: <a href="https://tram.sample.net/lines">https://tram.sample.net/lines</a></p>'
    '<p>Comments URL: <a href="https://talk.sample.net/t/88">https://talk.sample.net/t/88</a></p>'
)


def push(spark, *rows):
    built = cards.with_push_card(spark.createDataFrame(list(rows), ITEM)).orderBy("id").collect()
    return [json.loads(r.card)["card"] for r in built]


def test_push_card_strips_markup_and_offers_the_discussion(spark):
    first, second, bare = push(
        spark,
        (1, "Night  trams", LINKS, "Reason", "Feed", 0.42, "https://tram.sample.net/lines"),
        (2, "T" * 100, "plain", None, None, None, "https://bake.sample.net/ice"),
        (3, "x", "", "", "", 0.6, "https://example.com/3"),
    )
    assert first["header"] == {"template": "blue", "title": {"tag": "plain_text", "content": "Night trams"}}
    assert first["elements"][0]["text"]["content"] == f"**摘要**\n{cards.NO_SUMMARY}"
    assert [b["url"] for b in first["elements"][-1]["actions"]] == [
        "https://tram.sample.net/lines", "https://talk.sample.net/t/88",
    ]
    assert first["elements"][1]["fields"][1]["text"]["content"] == "**重要性**\n0.42"
    assert second["header"]["title"]["content"] == "T" * 77 + "..."
    assert [f["text"]["content"] for f in second["elements"][1]["fields"]] == ["**来源**\nUnknown source", "**重要性**\nN/A"]
    assert second["elements"][2]["text"]["content"] == "**推荐理由**\nNo analysis reason"
    assert len(second["elements"][-1]["actions"]) == 1 and set(second["elements"][-1]) == {"tag", "actions"}
    assert bare["header"]["template"] == "orange"


def test_discussion_link_must_differ_from_the_article(spark):
    row = (1, "t", "Comment URL: https://example.com/a.,;)", None, "f", 0.8, "https://example.com/a")
    (card,) = push(spark, row)
    assert len(card["elements"][-1]["actions"]) == 1 and card["header"]["template"] == "red"


def test_digest_card(spark):
    data = [
        (1, "Bread  ovens", "<p>Article URL: https://bake.sample.net/ovens Comments URL: https://talk.sample.net/t/9 Stone keeps heat</p>", "Bakers", 0.8, "https://bake.sample.net/ovens"),
        (2, "River ice", None, None, None, "https://bake.sample.net/ice"),
    ]
    df = spark.createDataFrame(data, "idx int, title string, summary string, source_name string, importance_score double, canonical_url string")
    (row,) = cards.digest_card(cards.with_digest_line(df)).collect()
    texts = [e["text"]["content"] for e in json.loads(row.card)["card"]["elements"]]
    assert row.n_items == 2 and texts[0].startswith("**本次收录 2 篇**\n")
    assert texts[1] == (
        "**1. [Bread ovens](https://bake.sample.net/ovens)**\nStone keeps heat\n"
        "来源: Bakers | 重要性: 0.80 | [讨论](https://talk.sample.net/t/9)"
    )
    assert texts[2].endswith(f"{cards.NO_SUMMARY}\n来源: Unknown source | 重要性: N/A")
    assert cards.digest_card(cards.with_digest_line(df.filter("idx > 5"))).isEmpty()


def test_importance_text_rounds_as_python_does(column):
    values = [i / 1000 for i in range(1000)]
    assert column(cards.importance_text, values, "double") == [f"{v:.2f}" for v in values]


def test_first_scalar_levels(spark):
    cases = [
        ({"k": 1, "event": {"k": 2}}, "1"),
        ({"k": {"x": 1}, "event": {"k": [1]}, "action": {"value": {"k": "deep"}}}, "deep"),
        ({"k": None, "event": {"k": 2}}, None),
        ({"event": {"j": "alias"}}, "alias"),
        ({"j": "a", "event": {"k": "b"}}, "a"),
        ({"action": "useful"}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = df.select("i", first_scalar(F.parse_json("p"), "k", "j")["value"].alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [want for _, want in cases]


def test_filled_follows_truthiness(spark):
    values = [("null", False), ('""', False), ("0", False), ("0.0", False), ("false", False), ('"0"', True), ("true", True), ("7", True)]
    df = spark.createDataFrame([(i, f'{{"k": {v}}}') for i, (v, _) in enumerate(values)], "i int, p string")
    got = df.select("i", is_filled(first_scalar(F.parse_json("p"), "k")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [want for _, want in values]


def test_feedback_problems(spark):
    cases = [
        ('{"item_id": "i", "action": "useful"}', None),
        ('{"action": {"value": {"item_id": "i", "action": "wrong_tag"}}}', None),
        ('{"item_id": "i", "action": "dance"}', UNKNOWN_ACTION),
        ('{"item_id": "i", "action": 5}', UNKNOWN_ACTION),
        ('{"item_id": "", "action": "useful"}', MISSING),
        ('{"action": "useful"}', MISSING),
        ("[1]", MALFORMED),
        ("{", MALFORMED),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, payload string")
    assert [r.problem for r in feedback_fields(df).orderBy("i").collect()] == [want for _, want in cases]


WORDS = ["", "model", "model product", "model product python"]


# Characters of title and content, then the score with 0 to 3 topics.
SCORES = [
    (30, 0.36, 0.51, 0.66, 0.81),
    (149, 0.399, 0.55, 0.7, 0.85),
    (150, 0.4, 0.55, 0.7, 0.85),
    (298, 0.449, 0.599, 0.749, 0.899),
    (299, 0.449, 0.6, 0.75, 0.9),
    (300, 0.45, 0.6, 0.75, 0.9),
    (449, 0.499, 0.65, 0.8, 0.95),
    (450, 0.5, 0.65, 0.8, 0.95),
    (748, 0.599, 0.749, 0.899, 0.95),
    (749, 0.599, 0.75, 0.9, 0.95),
    (750, 0.6, 0.75, 0.9, 0.95),
    (751, 0.6, 0.75, 0.9, 0.95),
    (900, 0.6, 0.75, 0.9, 0.95),
]
# Rounded up to the mark, but below it.
BARELY_NOT = (449, 1)


def test_scores_and_actions_at_the_edges(spark):
    cases = []
    for length, *scores in SCORES:
        for topics, (words, score) in enumerate(zip(WORDS, scores, strict=True)):
            cases.append((len(cases), words, "z" * (length - len(words) - 1), topics, score, length))
    df = spark.createDataFrame([c[:3] for c in cases], "id int, title string, content string")
    got = {r.id: r for r in analyze_items(df).collect()}
    for i, _, content, topics, score, length in cases:
        row = got[i]
        assert row.importance_score == score
        read_now = score >= READ_NOW_MIN and (length, topics) != BARELY_NOT
        assert row.recommended_action == ("read_now" if read_now else "digest")
        assert len(row.topics) == topics and row.tags == (row.topics or ["general"])
        assert row.novelty_score == (0.5 if topics else 0.35)
        assert row.summary == (content if len(content) <= 240 else content[:240] + "...")


def test_topics_match_substrings_and_cjk_and_summary_falls_back(spark):
    df = spark.createDataFrame([(1, "He SAID", None), (2, "新产品架构", " "), (3, None, "人工智能")], "id int, title string, content string")
    got = {r.id: (r.topics, r.summary) for r in analyze_items(df).collect()}
    assert got == {1: (["ai"], "He SAID"), 2: (["product", "engineering"], "新产品架构"), 3: (["ai"], "人工智能")}
