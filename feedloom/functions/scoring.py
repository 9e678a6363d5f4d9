"""The keyword analyzer: topics, scores, action and summary as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import blank_to_null, col_of, normalize_text

# Topics of interest and the substrings that signal them.
TOPIC_KEYWORDS = {
    "ai": ["ai", "llm", "model", "openai", "人工智能", "模型"],
    "product": ["product", "workflow", "用户", "产品"],
    "engineering": ["python", "docker", "api", "database", "工程", "架构"],
}
# Analyzer name and the texts it reports.
MODEL_NAME = "local-heuristic-v1"
ANALYZER = "local heuristic"
REASON_MATCH = "Matched active interest topics."
REASON_NO_MATCH = "No strong topic match; keep for digest review."
READ_NOW_MIN = 0.65
SUMMARY_CHARS = 240


def search_text(title: Column, content: Column) -> Column:
    """The lower-cased text that keywords are looked up in; both parts are already normalized."""
    return F.lower(F.trim(F.concat(title, F.lit(" "), content)))


def matched_topics(text: Column | str, lexicon: dict[str, list[str]] = TOPIC_KEYWORDS) -> Column:
    """Topics with at least one keyword inside ``text`` (substring match), in lexicon order."""
    found = []
    for topic, keywords in lexicon.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(col_of(text), F.lit(keyword))
        found.append(F.when(hit, F.lit(topic)))
    return F.array_compact(F.array(*found))


def raw_importance(topic_count: Column, text_chars: Column) -> Column:
    length_bonus = F.least(text_chars / F.lit(3000.0), F.lit(0.25))
    return F.least(F.lit(0.95), F.lit(0.35) + F.lit(0.15) * topic_count + length_bonus)


def importance_score(topic_count: Column, text_chars: Column) -> Column:
    return F.round(raw_importance(topic_count, text_chars), 3)


def summarize_normalized(title: Column, content: Column) -> Column:
    source = F.coalesce(blank_to_null(content), title)
    cut = F.concat(F.substring(source, 1, SUMMARY_CHARS), F.lit("..."))
    return F.when(F.length(source) > SUMMARY_CHARS, cut).otherwise(source)


def summarize(title: Column | str, content: Column | str) -> Column:
    """Normalized content, or the title if there is none, cut after 240 characters."""
    return summarize_normalized(normalize_text(title), normalize_text(content))


def keyword_analysis(topics: Column, text_chars: Column, summary: Column) -> Column:
    """Analysis result struct from the matched topics, the text length and the summary."""
    count = F.size(topics)
    any_topic = count > 0
    score = raw_importance(count, text_chars)
    return F.struct(
        F.lit(MODEL_NAME).alias("model_name"),
        summary.alias("summary"),
        topics.alias("topics"),
        F.when(any_topic, topics).otherwise(F.array(F.lit("general"))).alias("tags"),
        F.round(score, 3).alias("importance_score"),
        F.when(any_topic, F.lit(0.5)).otherwise(F.lit(0.35)).alias("novelty_score"),
        F.when(score >= READ_NOW_MIN, F.lit("read_now")).otherwise(F.lit("digest")).alias("recommended_action"),
        F.when(any_topic, F.lit(REASON_MATCH)).otherwise(F.lit(REASON_NO_MATCH)).alias("reason"),
        F.to_json(
            F.struct(F.lit(ANALYZER).alias("analyzer"), topics.alias("matched_topics"))
        ).alias("raw_output"),
    )
