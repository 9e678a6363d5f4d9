"""Message cards: text clean-up, colours and the nested card objects as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import with_html_text
from feedloom.functions.params import DIGEST_MAX
from feedloom.functions.text import SPACE_CLASS, first_filled, normalize_text, truncate_normalized, truncate_text

# Labels and fallbacks shown on cards.
NO_SUMMARY = "No summary available."
NO_REASON = "No analysis reason"
UNKNOWN_SOURCE = "Unknown source"
NO_SCORE = "N/A"
LABEL_SUMMARY, LABEL_SOURCE, LABEL_SCORE, LABEL_REASON = "摘要", "来源", "重要性", "推荐理由"
BUTTON_READ, BUTTON_DISCUSS = "阅读全文", "讨论"
DIGEST_TITLE = "信息流摘要"
DIGEST_INTRO = "**本次收录 %d 篇**\n按入库时间从新到旧排列。"

# Card colours by importance.
RED_MIN, ORANGE_MIN = 0.75, 0.6

_NOT_SPACE = rf"[^{SPACE_CLASS}]"
_URL_LABELS = rf"(?iU)\b(?:Article|Comments?) URL:[{SPACE_CLASS}]*"
_BARE_URLS = rf"(?U)https?://{_NOT_SPACE}+"
_COMMENTS_LINK = rf"(?iU)\bComments? URL:[{SPACE_CLASS}]*(https?://{_NOT_SPACE}+)"


def text_without_urls(plain: Column) -> Column:
    """Plain text without link labels and bare URLs."""
    unlabeled = F.regexp_replace(plain, _URL_LABELS, "")
    return normalize_text(F.regexp_replace(unlabeled, _BARE_URLS, ""))


def discussion_link(*plains: Column) -> Column:
    """The first labelled discussion link in the given plain texts, else ''."""
    found = [
        F.nullif(F.regexp_extract(plain, _COMMENTS_LINK, 1), F.lit("")) for plain in plains
    ]
    return F.coalesce(F.rtrim(F.coalesce(*found), F.lit(".,;)")), F.lit(""))


def importance_text(score: Column) -> Column:
    return F.coalesce(F.format_number(score.cast("double"), 2), F.lit(NO_SCORE))


def card_template(score: Column) -> Column:
    value = score.cast("double")
    return (
        F.when(value >= RED_MIN, F.lit("red"))
        .when(value >= ORANGE_MIN, F.lit("orange"))
        .otherwise(F.lit("blue"))
    )


def _tagged(tag: str, content: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), content.alias("content"))


_FIELDS_TYPE = "array<struct<is_short:boolean,text:struct<tag:string,content:string>>>"
_ACTIONS_TYPE = (
    "array<struct<tag:string,text:struct<tag:string,content:string>,type:string,url:string>>"
)


def _element(
    tag: str = "div",
    text: Column | None = None,
    fields: Column | None = None,
    actions: Column | None = None,
) -> Column:
    no_text = F.lit(None).cast("struct<tag:string,content:string>")
    return F.struct(
        F.lit(tag).alias("tag"),
        (no_text if text is None else _tagged("lark_md", text)).alias("text"),
        (F.lit(None) if fields is None else fields).cast(_FIELDS_TYPE).alias("fields"),
        (F.lit(None) if actions is None else actions).cast(_ACTIONS_TYPE).alias("actions"),
    )


def _labelled(label: str, content: Column) -> Column:
    return F.concat(F.lit(f"**{label}**\n"), content)


def _button(label: str, kind: str, url: Column) -> Column:
    return F.struct(
        F.lit("button").alias("tag"),
        _tagged("plain_text", F.lit(label)).alias("text"),
        F.lit(kind).alias("type"),
        url.alias("url"),
    )


def _card(template: Column, title: Column, elements: Column) -> Column:
    return F.struct(
        F.lit("interactive").alias("msg_type"),
        F.struct(
            F.struct(F.lit(True).alias("wide_screen_mode")).alias("config"),
            F.struct(
                template.alias("template"), _tagged("plain_text", title).alias("title")
            ).alias("header"),
            elements.alias("elements"),
        ).alias("card"),
    )


def with_push_card(items: DataFrame) -> DataFrame:
    """Add the single-item card fields and the card as JSON.

    Needs title, summary, reason, source_name, importance_score and canonical_url.
    """
    plain = with_html_text(items, {"__summary": "summary", "__reason": "reason"})
    link = discussion_link(F.col("__summary"), F.col("__reason"))
    reason = F.when(
        F.coalesce(F.col("reason"), F.lit("")) == "", F.lit(NO_REASON)
    ).otherwise(text_without_urls(F.col("__reason")))
    fields = plain.withColumns(
        {
            "card_title": truncate_text("title", 80),
            "card_summary": first_filled(
                truncate_normalized(text_without_urls(F.col("__summary")), 420), F.lit(NO_SUMMARY)
            ),
            "card_reason": truncate_normalized(reason, 240),
            "card_source": truncate_text(first_filled(F.col("source_name"), F.lit(UNKNOWN_SOURCE)), 80),
            "card_importance": importance_text(F.col("importance_score")),
            "card_template": card_template(F.col("importance_score")),
            "card_discussion_url": F.when(
                (link != "") & ~link.eqNullSafe(F.col("canonical_url")), link
            ),
        }
    ).drop("__summary", "__reason")

    discuss = F.col("card_discussion_url")
    buttons = F.array_compact(
        F.array(
            _button(BUTTON_READ, "primary", F.col("canonical_url")),
            F.when(discuss.isNotNull(), _button(BUTTON_DISCUSS, "default", discuss)),
        )
    )

    def short_field(label: str, content: Column) -> Column:
        return F.struct(
            F.lit(True).alias("is_short"),
            _tagged("lark_md", _labelled(label, content)).alias("text"),
        )

    # All elements share one type; to_json leaves out the parts that are null.
    elements = F.array(
        _element(text=_labelled(LABEL_SUMMARY, F.col("card_summary"))),
        _element(
            fields=F.array(
                short_field(LABEL_SOURCE, F.col("card_source")),
                short_field(LABEL_SCORE, F.col("card_importance")),
            )
        ),
        _element(text=_labelled(LABEL_REASON, F.col("card_reason"))),
        _element(tag="action", actions=buttons),
    )
    card = _card(F.col("card_template"), F.col("card_title"), elements)
    return fields.withColumn("card", F.to_json(card))


def with_digest_line(items: DataFrame) -> DataFrame:
    """Add the digest line of each item; needs idx besides the card inputs."""
    plain = with_html_text(items, {"__summary": "summary"})
    link = discussion_link(F.col("__summary"))
    source = truncate_text(first_filled(F.col("source_name"), F.lit(UNKNOWN_SOURCE)), 50)
    metadata = F.concat(
        F.lit(f"{LABEL_SOURCE}: "),
        source,
        F.lit(f" | {LABEL_SCORE}: "),
        importance_text(F.col("importance_score")),
        F.when(
            (link != "") & ~link.eqNullSafe(F.col("canonical_url")),
            F.concat(F.lit(f" | [{BUTTON_DISCUSS}]("), link, F.lit(")")),
        ).otherwise(F.lit("")),
    )
    summary = first_filled(
        truncate_normalized(text_without_urls(F.col("__summary")), 180), F.lit(NO_SUMMARY)
    )
    line = F.concat(
        F.lit("**"),
        F.col("idx").cast("string"),
        F.lit(". ["),
        truncate_text("title", 90),
        F.lit("]("),
        F.col("canonical_url"),
        F.lit(")**\n"),
        summary,
        F.lit("\n"),
        metadata,
    )
    return plain.withColumn("line", line).drop("__summary")


def digest_card(lines: DataFrame, keys: list[str] | None = None, title: str = DIGEST_TITLE) -> DataFrame:
    """One digest card per key from its numbered lines, of which those up to ``DIGEST_MAX`` are taken."""
    grouped = lines.filter(F.col("idx") <= DIGEST_MAX).groupBy(*(keys or [])).agg(
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("__lines"),
    )
    intro = F.array(_element(text=F.format_string(DIGEST_INTRO, F.col("n_items"))))
    elements = F.concat(intro, F.transform("__lines", lambda x: _element(text=x["line"])))
    return (
        grouped.filter("n_items > 0")
        .withColumn("card", F.to_json(_card(F.lit("blue"), F.lit(title), elements)))
        .drop("__lines")
    )
