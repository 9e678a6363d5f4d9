"""DuckDB SQL with the same result as each registered query."""

from __future__ import annotations

from feedloom.functions.scoring import TOPIC_KEYWORDS
from feedloom.plans.fixtures import TABLE_NAMES

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"\x{4e00}-\x{9fff}"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 3})) || '...' END"


def slug(x: str) -> str:
    return (
        f"coalesce(nullif(substr(lower(trim(regexp_replace({x}, '[^a-zA-Z0-9{CJK}]+', '-', 'g'), '-')), 1, 80), ''),"
        " 'item')"
    )


def canon(u: str) -> str:
    query = (
        f"list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda q: q <> '' AND NOT "
        "regexp_matches(lower(q), '^(utm_.*|(fbclid|gclid|igshid|mc_cid|mc_eid)(=.*)?)$')))"
    )
    path = f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return (
        f"(lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*')) || coalesce(nullif({path}, ''), '/')"
        f" || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END)"
    )


def html_text(h: str) -> str:
    plain = (
        f"replace(replace(replace(replace({h}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
    )
    tokens = (
        f"regexp_extract_all({plain}, "
        "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+')"
    )
    text = (
        "CASE WHEN t LIKE '<script%' OR t LIKE '<style%' THEN regexp_replace(t, '^<[^>]*>|</[a-z]+>$', '', 'g')"
        " WHEN t LIKE '<%' THEN '' ELSE t END"
    )
    return norm(f"array_to_string(list_transform({tokens}, lambda t: {text}), ' ')")


def stamp(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S')"


START = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-01-20 00:00:00'"
HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"

ITEMS = f"""items AS (
  SELECT doc_id AS id, source || ' #' || doc_id AS title, text AS content,
         'https://' || source || '.example.org/' || lang || '/' || doc_id AS canonical_url,
         source AS source_name, lang, n_chars, {START} + to_seconds(doc_id * 60) AS created_at
  FROM documents)"""

def _topics() -> str:
    cases = []
    for topic, words in TOPIC_KEYWORDS.items():
        test = " OR ".join(f"contains(lt, '{w}')" for w in words)
        cases.append(f"CASE WHEN {test} THEN '{topic}' END")
    return f"list_filter([{', '.join(cases)}], lambda t: t IS NOT NULL)"


RAW_SCORE = "least(0.95::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * len(topics) + least(length(lt) / 3000::DOUBLE, 0.25::DOUBLE))"
ANALYZED = f"""{ITEMS},
texts AS (
  SELECT *, lower({norm("title || ' ' || content")}) AS lt,
         coalesce(nullif({norm("content")}, ''), {norm("title")}) AS source_text FROM items),
topical AS (SELECT *, {_topics()} AS topics FROM texts),
analyzed AS (
  SELECT *, round({RAW_SCORE}, 3) AS importance_score, {RAW_SCORE} AS raw_score,
         CASE WHEN length(source_text) > 240 THEN substr(source_text, 1, 240) || '...' ELSE source_text END AS summary
  FROM topical)"""

ANALYSIS_LOG = f"""{ANALYZED},
analysis_log AS (
  SELECT 1 AS id, id AS item_id, importance_score, created_at FROM analyzed
  UNION ALL
  SELECT 2, doc_id, 0.45::DOUBLE + 0.25::DOUBLE * quality, {START} + to_seconds(doc_id * 60 + 30) FROM labels),
latest_score AS (
  SELECT item_id, importance_score FROM analysis_log
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, id DESC) = 1)"""

PUSH_LOG = """push_log AS (
  SELECT user_id AS item_id, CASE event_type WHEN 'purchase' THEN 'dry-run:digest' ELSE 'dry-run' END AS recipient,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'sent' WHEN event_type = 'error' THEN 'failed'
              ELSE 'pending' END AS status
  FROM events)"""

BARE = "regexp_replace(url, '#.*', '')"
RAW = f"""raw AS (
  SELECT page_id, url, {TITLE} AS title, html AS raw_content FROM pages
  UNION ALL
  SELECT page_id + 1000000000000, replace({BARE}, 'https://', 'HTTPS://')
         || CASE WHEN contains({BARE}, '?') THEN '&' ELSE '?' END || 'UTM_medium=rss&gclid=' || page_id || '#copy',
         {TITLE}, html FROM pages)"""

DUPLICATES = f"""{ITEMS},
rows_ AS (
  SELECT id, created_at, source_name || '/' || lang || '/' || n_chars AS url, sha256(content) AS hash FROM items),
parents AS (
  SELECT id, created_at, nullif(least(min(id) OVER (PARTITION BY url), min(id) OVER (PARTITION BY hash)), id) AS parent_id
  FROM rows_)"""

CARD_ITEMS = f"""{ANALYSIS_LOG}, {PUSH_LOG},
linked AS (
  SELECT *, 'https://news.example.org/item?id=' || id AS link,
         summary || ' <p>' || CASE lang WHEN 'en' THEN 'Article' ELSE 'Comments' END || ' URL: <a href="'
         || 'https://news.example.org/item?id=' || id || '">' || 'https://news.example.org/item?id=' || id
         || ').</a></p>' AS marked_up
  FROM analyzed),
card_items AS (
  SELECT *, {html_text("marked_up")} AS plain, CASE lang WHEN 'en' THEN '' ELSE link END AS discussion FROM linked),
cleaned AS (
  SELECT *, {norm("regexp_replace(regexp_replace(plain, '(?:Article|Comments?) URL: ?', '', 'g'), 'https?://[^ ]+', '', 'g')")}
         AS card_text FROM card_items)"""

ANY_TOPIC = "len(topics) > 0"
REASON = f"CASE WHEN {ANY_TOPIC} THEN 'Matched active interest topics.' ELSE 'No strong topic match; keep for digest review.' END"
COLOUR = "CASE WHEN importance_score >= 0.75 THEN 'red' WHEN importance_score >= 0.6 THEN 'orange' ELSE 'blue' END"
CARDS = f"""{CARD_ITEMS},
cards AS (
  SELECT id, {cut(norm("title"), 80)} AS card_title,
         coalesce(nullif({cut("card_text", 420)}, ''), 'No summary available.') AS card_summary,
         {cut(REASON, 240)} AS card_reason, source_name AS card_source,
         printf('%.2f', importance_score) AS card_importance, {COLOUR} AS card_template,
         nullif(discussion, '') AS card_discussion_url, canonical_url, importance_score
  FROM cleaned)"""


def _json(text: str) -> str:
    return f"to_json({text})"


def _md(text: str) -> str:
    return f"""'{{"tag":"div","text":{{"tag":"lark_md","content":' || {_json(text)} || '}}}}'"""


def _short(label: str, text: str) -> str:
    return (
        f"""'{{"is_short":true,"text":{{"tag":"lark_md","content":' || {_json(f"'**{label}**' || chr(10) || {text}")} || '}}}}'"""
    )


def _button(label: str, kind: str, url: str) -> str:
    return (
        f"""'{{"tag":"button","text":{{"tag":"plain_text","content":"{label}"}},"type":"{kind}","url":' || {_json(url)} || '}}'"""
    )


def _envelope(template: str, title: str, elements: str) -> str:
    return (
        """'{"msg_type":"interactive","card":{"config":{"wide_screen_mode":true},"header":{"template":"' || """
        f"""{template} || '","title":{{"tag":"plain_text","content":' || {_json(title)} || '}}}},"elements":[' || """
        f"{elements} || ']}}}}'"
    )


PUSH_JSON = _envelope(
    "card_template",
    "card_title",
    " || ',' || ".join(
        [
            _md("'**摘要**' || chr(10) || card_summary"),
            f"""'{{"tag":"div","fields":[' || {_short("来源", "card_source")} || ',' || {_short("重要性", "card_importance")} || ']}}'""",
            _md("'**推荐理由**' || chr(10) || card_reason"),
            f"""'{{"tag":"action","actions":[' || {_button("阅读全文", "primary", "canonical_url")} || """
            f"""CASE WHEN card_discussion_url IS NOT NULL THEN ',' || {_button("讨论", "default", "card_discussion_url")} ELSE '' END || ']}}'""",
        ]
    ),
)

CANDIDATES = f"""{CARD_ITEMS},
candidates AS (
  SELECT c.* EXCLUDE (importance_score), s.importance_score
  FROM cleaned c JOIN latest_score s ON s.item_id = c.id
  WHERE s.importance_score >= 0.5 AND s.importance_score < 0.75
    AND NOT EXISTS (SELECT 1 FROM push_log p
                    WHERE p.item_id = c.id AND p.status = 'sent' AND p.recipient = 'dry-run:digest'))"""

LINES = f"""{CANDIDATES},
numbered AS (
  SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS idx, *
  FROM (SELECT * FROM candidates ORDER BY created_at DESC, id DESC LIMIT 10)),
lines AS (
  SELECT idx, id, '**' || idx || '. [' || ({cut(norm("title"), 90)}) || '](' || canonical_url || ')**' || chr(10)
         || coalesce(nullif({cut("card_text", 180)}, ''), 'No summary available.') || chr(10)
         || '来源: ' || source_name || ' | 重要性: ' || printf('%.2f', importance_score)
         || CASE WHEN discussion <> '' THEN ' | [讨论](' || discussion || ')' ELSE '' END AS line
  FROM numbered)"""

DIGEST_JSON = _envelope(
    "'blue'",
    "'信息流摘要'",
    _md("'**本次收录 ' || count(*) || ' 篇**' || chr(10) || '按入库时间从新到旧排列。'")
    + f" || string_agg(',' || {_md('line')}, '' ORDER BY idx)",
)

LINK = "'https://' || source || '.example.org/' || doc_id"
LOCAL = "(ts + INTERVAL 8 HOUR)"
DAY = f"date_trunc('day', {LOCAL})"


def slot(*minutes: int) -> str:
    cases = " ".join(
        f"WHEN {DAY} + INTERVAL {m} MINUTE > {LOCAL} THEN {DAY} + INTERVAL {m} MINUTE" for m in minutes
    )
    return f"CASE {cases} ELSE {DAY} + INTERVAL 1 DAY + INTERVAL {minutes[0]} MINUTE END"


FEEDBACK = """fb AS (
  SELECT event_id, user_id::VARCHAR AS item,
         CASE event_type WHEN 'view' THEN 'useful' WHEN 'click' THEN 'save_obsidian' WHEN 'purchase' THEN 'read_later'
              WHEN 'error' THEN 'explode' END AS action, event_type FROM events)"""

_PAGE_ITEMS = f"""landed AS (
  SELECT page_id, url, html, {HOST} AS source_url, {TITLE} AS title,
         CASE WHEN NOT contains(url, '#') THEN {START} + to_seconds(page_id * 3600) END AS published_at FROM pages),
head AS (
  SELECT * FROM landed QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY page_id) <= 5),
fresh AS (
  SELECT *, {html_text("html")} AS content FROM head
  WHERE (published_at IS NULL OR published_at >= {NOW} - INTERVAL 15 DAY)
    AND page_id NOT IN (SELECT doc_id FROM labels))"""

ORACLE: dict[str, str] = {
    "rss_atom_scan": f"""
        WITH d AS (
          SELECT *, {LINK} AS link, {norm("text")} AS body, coalesce(nullif(text, ''), 'null') AS raw,
                 '{{http://www.w3.org/2005/Atom}}' AS atom FROM documents)
        SELECT link AS source_url, 'Feed ' || source AS source_name, 'g' || doc_id AS external_id, link AS url,
               'T ' || doc_id AS title, CASE lang WHEN 'fr' THEN 'Bob' END AS author, body AS content, 0 AS pos,
               CASE lang WHEN 'en' THEN '2024-01-10 04:00:00' ELSE '2024-01-10 12:00:00' END AS published,
               CASE lang WHEN 'en' THEN array_to_string(['description=' || raw, 'guid=g' || doc_id, 'link= ' || link,
                   'pubDate=Wed, 10 Jan 2024 12:00:00 +0800', 'title=T ' || doc_id, '{{urn:media}}credit=Eve'], '|')
               ELSE array_to_string([atom || 'author=null', atom || 'id=g' || doc_id, atom || 'link=null',
                   atom || 'summary=' || raw, atom || 'title=T ' || doc_id, atom || 'updated=2024-01-10T12:00:00Z'], '|') END AS payload
        FROM d WHERE lang IN ('en', 'fr')
        UNION ALL
        SELECT link, 'Feed ' || source, link || '/b', link || '/b', link || '/b', 'Ann', 'short', 1, NULL,
               array_to_string(['link=' || link || '/b', '{{http://purl.org/dc/elements/1.1/}}creator=Ann',
                 '{{http://purl.org/rss/1.0/modules/content/}}encoded=<p>short <a:b> </p>'], '|')
        FROM d WHERE lang = 'en'""",
    "feed_rejects": f"""
        SELECT {LINK} AS source_url, CASE lang WHEN 'de' THEN 'Unsupported feed format' ELSE 'Malformed feed document' END AS reason,
               length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
               + CASE lang WHEN 'de' THEN length('<opml><body></body></opml>') ELSE length('<rss><channel><item>') END AS n_chars
        FROM documents WHERE lang NOT IN ('en', 'fr')""",
    "feed_encodings": f"""
        WITH d AS (
          SELECT *, 'https://e.org/' || doc_id AS link, regexp_replace(text, '[^\\x{{20}}-\\x{{7e}}\\x{{a0}}-\\x{{ff}}\\n]', '?', 'g') AS latin
          FROM documents)
        SELECT link || '/feed' AS source_url, 'F\u00e9ed' AS source_name, link AS url, {norm("latin")} AS content,
               NULL AS reason, NULL AS n_chars
        FROM d WHERE lang IN ('en', 'fr', 'de')
        UNION ALL
        SELECT link || '/feed', link || '/feed', NULL, '', 'Unreadable encoding',
               length('<rss><channel><title>F\u00e9ed</title><item><link></link><description></description></item></channel></rss>')
               + length(link) + length(replace(replace(latin, '&', '&amp;'), '<', '&lt;')) + 1
        FROM d WHERE lang NOT IN ('en', 'fr', 'de')""",
    "reader_scan": f"""
        SELECT 'https://reader.example.org/api' AS source_url, source AS source_name, 'tag:' || doc_id AS external_id,
               'https://example.org/' || doc_id AS url, 'T ' || doc_id AS title, 'Ada' AS author, {norm("text")} AS content,
               0 AS pos, CASE WHEN lang <> 'fr' THEN {stamp("make_timestamp((1704067200 + doc_id) * 1000000)")} END AS published,
               CASE lang WHEN 'fr' THEN 9 ELSE 7 END AS n_keys, '{{"title":"' || source || '"}}' AS origin,
               CASE lang WHEN 'fr' THEN 'null' END AS none
        FROM documents WHERE lang <> 'es'
        UNION ALL
        SELECT 'https://reader.example.org/api', 'https://reader.example.org/api', 'alt:' || doc_id,
               'https://example.org/' || doc_id || '/alt', 'https://example.org/' || doc_id || '/alt', NULL, 'Hi you', 1,
               {stamp("make_timestamp((1704067200 + n_chars) * 1000000)")}, 5, NULL, NULL
        FROM documents WHERE lang <> 'es'""",
    "payload_map": """
        SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) + 1 AS n_keys, 'null' AS none
        FROM events""",
    "split_list": f"""
        WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {strip("x")}), lambda x: x <> '') AS parts
                   FROM documents)
        SELECT doc_id, len(parts) AS n_parts, array_to_string(parts, '|') AS parts FROM p""",
    "union_sources": f"""
        SELECT 'reader' AS origin, doc_id AS id, source AS feed FROM documents
        UNION ALL SELECT 'rss', page_id, {HOST} FROM pages""",
    "sample_with_documents": """
        SELECT 'Built-in journal' AS source_name, 'journal-0001' AS external_id,
               'How we moved the search index to a new database without downtime' AS title, 141 AS n_chars
        UNION ALL SELECT source, doc_id::VARCHAR, 'T ' || doc_id, length(text) FROM documents""",
    "missing_tables": "WITH found AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLE_NAMES)
    + "), required AS (SELECT table_name FROM found UNION ALL VALUES ('archive'), ('ledger')) "
    "SELECT table_name FROM required EXCEPT SELECT table_name FROM found WHERE n > 0",
    "note_upsert": f"""
        SELECT user_id::VARCHAR AS item_id, 'notes/' || event_type || '-' || event_id || '.md' AS path,
               'written' AS status, {stamp("date_trunc('day', ts)")} AS updated_at
        FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC,
            CASE WHEN event_id % 2 = 0 THEN 'feedback' ELSE 'notes' END DESC, event_id DESC) = 1""",
    "table_inventory": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLE_NAMES
    ),
    "upsert_latest_source": f"""
        SELECT {HOST} AS url, {TITLE} AS name, page_id AS seq FROM pages
        QUALIFY row_number() OVER (PARTITION BY {HOST} ORDER BY page_id DESC) = 1""",
    "upsert_raw_merge": f"""
        WITH v AS (
          SELECT *, first_value(event_id) OVER w AS url, {stamp("first_value(ts) OVER w")} AS created_at,
                 count(*) OVER (PARTITION BY user_id, event_type) AS n_versions,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
          FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
        SELECT user_id, event_type, url, created_at, value AS content, props, n_versions FROM v WHERE rn = 1""",
    "raw_url_conflicts": f"""
        WITH {RAW}, c AS (SELECT page_id, {canon("url")} AS url FROM raw)
        SELECT page_id, url, page_id <> min(page_id) OVER (PARTITION BY url) AS conflict FROM c""",
    "normalize_insert_absent": f"""
        WITH {RAW}, c AS (SELECT page_id, title, {canon("url")} AS canonical_url, {norm("raw_content")} AS content FROM raw)
        SELECT page_id, canonical_url, title, sha256(title || chr(10) || canonical_url || chr(10) || content) AS normalized_hash
        FROM c WHERE canonical_url NOT IN (SELECT {canon("url")} FROM pages WHERE contains(url, 'utm_source'))
        QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) = 1""",
    "push_event_log": f"""
        SELECT event_id::VARCHAR AS item_id, 'feishu' AS channel, 'dry-run' AS recipient, 'dry-run' AS message_id,
               CASE event_type WHEN 'error' THEN 'failed' ELSE 'sent' END AS status,
               CASE event_type WHEN 'error' THEN 'timeout' END AS last_error, {stamp(NOW)} AS sent_at
        FROM events""",
    "note_export": f"""
        WITH {ANALYZED},
        n AS (
          SELECT a.*, a.source_name || ' ' || a.lang AS note_title,
                 (CASE WHEN l.toxic = 0 THEN a.created_at ELSE {NOW} END) + INTERVAL 8 HOUR AS day
          FROM analyzed a JOIN labels l ON l.doc_id = a.id),
        s AS (
          SELECT *, 'notes/' || strftime(day, '%Y/%m/') || {slug("note_title")} AS stem FROM n)
        SELECT id::VARCHAR AS item_id, strftime(day, '%Y') AS year, strftime(day, '%m') AS month,
               stem || '-' || substr(sha256(id::VARCHAR), 1, 12) || '.md' AS path,
               array_to_string(['---', 'source: "' || source_name || '"', 'url: "' || canonical_url || '"',
                 'published: "' || strftime(day, '%Y-%m-%d') || '"', 'item_id: "' || id || '"', '---', '',
                 '# ' || note_title, '', '## Summary', '', summary, '', '## Original', '', canonical_url || chr(10)],
                 chr(10)) AS markdown
        FROM s""",
    "push_card": f"""
        WITH {CARDS}
        SELECT id, card_title, card_summary, card_reason, card_source, card_importance, card_template,
               card_discussion_url, {PUSH_JSON} AS card FROM cards""",
    "digest_lines": f"WITH {LINES} SELECT idx, id, line FROM lines",
    "digest_card": f"WITH {LINES} SELECT count(*) AS n_items, {DIGEST_JSON} AS card FROM lines",
    "status_derivation": f"""
        WITH {DUPLICATES.replace(ITEMS + ',', ANALYSIS_LOG + ',', 1)}, {PUSH_LOG},
        pushed AS (SELECT DISTINCT item_id FROM push_log WHERE status = 'sent' AND recipient = 'dry-run')
        SELECT p.id, p.parent_id IS NOT NULL AS is_duplicate,
               CASE WHEN p.parent_id IS NOT NULL THEN 'ignored' WHEN pu.item_id IS NOT NULL THEN 'pushed'
                    WHEN s.importance_score IS NULL THEN 'new' WHEN s.importance_score < 0.5 THEN 'archived'
                    ELSE 'ready' END AS status
        FROM parents p LEFT JOIN latest_score s ON s.item_id = p.id LEFT JOIN pushed pu ON pu.item_id = p.id""",
    "age_guard": f"""
        SELECT event_id, event_type FROM events
        WHERE event_type = 'signup' OR ts >= {NOW} - INTERVAL 7 DAY""",
    "drop_empty_url": "SELECT page_id, url FROM pages WHERE url LIKE 'https://%'",
    "positive_int": """
        SELECT event_id, coalesce(nullif(greatest(CAST(json_extract_string(props, '$.k') AS INTEGER), 0), 0), 7)::INTEGER AS n
        FROM events""",
    "clamp_limit": """
        WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_id, least(greatest(k, 1), 20)::INTEGER AS digest_limit,
               least(greatest(k * 10, 1), 200)::INTEGER AS page_size, 10::INTEGER AS fallback FROM k""",
    "score_band": "SELECT event_id, value FROM events WHERE value >= 50 AND value < 150",
    "past_stage_skip": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "feedback_validate": f"""
        WITH {FEEDBACK}
        SELECT event_id, CASE WHEN action IS NULL THEN 'item_id and action are required'
                              WHEN action = 'explode' THEN 'invalid feedback action' ELSE 'accepted' END AS outcome FROM fb""",
    "feedback_fields": f"""
        WITH {FEEDBACK}
        SELECT event_id, CASE WHEN action IS NOT NULL THEN item END AS item_id, action,
               CASE event_type WHEN 'click' THEN event_id::VARCHAR END AS push_event_id,
               CASE event_type WHEN 'purchase' THEN item END AS user_id FROM fb""",
    "note_requests": "SELECT DISTINCT user_id::VARCHAR AS item_id FROM events WHERE event_type = 'click'",
    "push_skip": f"""
        WITH {PUSH_LOG}
        SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM push_log WHERE status = 'sent')""",
    "join_item_raw_source": """
        SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "latest_per_key_left": """
        WITH o AS (SELECT * FROM orders
                   QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "not_yet_sent_anti": """
        SELECT c_custkey AS id, c_name FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')""",
    "exists_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "dedupe_parent": f"WITH {DUPLICATES} SELECT id, parent_id FROM parents",
    "new_keys_anti": "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
    "in_subquery_semi": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "distinct_canonical_url": f"""
        WITH {RAW}
        SELECT {canon("url")} AS canonical_url, min(page_id) AS page_id, count(*) AS n_copies FROM raw GROUP BY 1""",
    "dedupe_groups": f"""
        WITH RECURSIVE {DUPLICATES},
        walk AS (
          SELECT id, coalesce(parent_id, id) AS at FROM parents
          UNION ALL
          SELECT w.id, p.parent_id FROM walk w JOIN parents p ON p.id = w.at WHERE p.parent_id IS NOT NULL)
        SELECT p.id, min(w.at) AS group_id, CASE WHEN p.parent_id IS NULL THEN 'new' ELSE 'ignored' END AS status
        FROM parents p JOIN walk w ON w.id = p.id GROUP BY p.id, p.parent_id""",
    "pipeline_groups": f"""
        WITH RECURSIVE {DUPLICATES},
        walk AS (
          SELECT id, coalesce(parent_id, id) AS at FROM parents
          UNION ALL
          SELECT w.id, p.parent_id FROM walk w JOIN parents p ON p.id = w.at WHERE p.parent_id IS NOT NULL)
        SELECT p.id, min(w.at) AS group_id, CASE WHEN p.parent_id IS NULL THEN 'new' ELSE 'ignored' END AS status
        FROM parents p JOIN walk w ON w.id = p.id GROUP BY p.id, p.parent_id""",
    "settled_writers": f"""
        WITH d AS (
          SELECT doc_id, source, {norm("text")} AS content,
                 'https://' || source || '.example.org/' || lang || '/' || doc_id AS canonical_url FROM documents),
        g AS (
          SELECT canonical_url, first_value(canonical_url) OVER (
                   PARTITION BY source, content, CASE WHEN content = '' THEN doc_id END
                   ORDER BY doc_id % 3 = 0, doc_id) AS first_url
          FROM d)
        SELECT canonical_url, first_url, canonical_url <> first_url AS is_duplicate,
               CASE WHEN canonical_url = first_url THEN 'pushed' ELSE 'ignored' END AS status, 1 AS n_raw, 1 AS n_items,
               (canonical_url = first_url)::BIGINT AS n_analyses, (canonical_url = first_url)::BIGINT AS n_messages
        FROM g""",
    "slot_digests": f"""
        WITH {ANALYSIS_LOG}, {PUSH_LOG},
        w AS (
          SELECT i.id, i.created_at FROM items i JOIN latest_score s ON s.item_id = i.id
          WHERE s.importance_score >= 0.5 AND s.importance_score < 0.75 AND i.id NOT IN (
            SELECT item_id FROM push_log WHERE status = 'sent' AND recipient IN ('dry-run', 'dry-run:digest'))),
        s1 AS (SELECT id FROM w WHERE created_at <= {START} + INTERVAL 60 MINUTE ORDER BY created_at DESC LIMIT 10),
        s2 AS (SELECT id FROM w WHERE created_at <= {START} + INTERVAL 90 MINUTE AND id NOT IN (FROM s1)
               ORDER BY created_at DESC LIMIT 10),
        s3 AS (SELECT id FROM w WHERE created_at <= {START} + INTERVAL 150 MINUTE AND id NOT IN (FROM s1)
                 AND id NOT IN (FROM s2) ORDER BY created_at DESC LIMIT 10)
        SELECT 1 AS slot, id, 'sent' AS status FROM s1 UNION ALL SELECT 2, id, 'sent' FROM s2
        UNION ALL SELECT 3, id, 'sent' FROM s3""",
    "retry_leases": f"""
        WITH l AS (
          SELECT user_id AS item_id, ts + INTERVAL 1 HOUR AS leased_until, event_id % 4 AS w, event_id // 1000 AS batch_id
          FROM events)
        SELECT DISTINCT item_id FROM l WHERE w = 0 AND batch_id = 0 AND item_id NOT IN (
          SELECT item_id FROM l
          WHERE NOT (w = 0 AND batch_id = 0) AND leased_until > TIMESTAMP '2024-01-29 00:00:00' AND batch_id % 2 = 0)""",
    "feed_head_n_then_age": f"""
        WITH h AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3)
        SELECT conv_id, turn, role FROM h
        WHERE role = 'system' OR {START} + to_seconds(conv_id * 7200) >= {NOW} - INTERVAL 7 DAY""",
    "feed_head_over_pages": """
        WITH e AS (
          SELECT source, doc_id, unnest(string_split(text, ' ')) AS entry,
                 (generate_subscripts(string_split(text, ' '), 1) - 1)::INT AS pos
          FROM documents)
        SELECT source, doc_id, pos, entry FROM e
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) <= 100""",
    "check_batch": """
        WITH c AS (
          SELECT event_id, user_id, ts, nullif(concat_ws(',', CASE WHEN value IS NULL THEN 'null:value' END,
                   CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'domain:event_type' END,
                   CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer) THEN 'orphan:user_id' END), '') AS broken
          FROM events)
        SELECT event_id, user_id, CASE WHEN broken IS NOT NULL THEN broken
               WHEN user_id IN (SELECT doc_id FROM labels) THEN 'unique:user_id'
               WHEN user_id IS NOT NULL AND row_number() OVER (PARTITION BY user_id, broken IS NULL ORDER BY ts, event_id) > 1
               THEN 'unique:user_id' END AS refused
        FROM c""",
    "latest_analysis": """
        SELECT user_id, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "digest_select": f"""
        WITH {CANDIDATES}
        SELECT id, title, canonical_url, source_name, importance_score FROM candidates
        ORDER BY created_at DESC, id DESC LIMIT 10""",
    "digest_backlog": f"WITH {CANDIDATES} SELECT source_name, count(*) AS n_waiting FROM candidates GROUP BY 1",
    "except_keys": "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS normalize_text FROM documents",
    "sha256_text": "SELECT doc_id, sha256(text) AS sha256_text FROM documents",
    "truncate_text": f"""
        WITH n AS (SELECT doc_id, {norm("text")} AS v FROM documents)
        SELECT doc_id, {cut("v", 100)} AS truncate_text FROM n""",
    "slugify": f"SELECT doc_id, {slug('text')} AS slugify FROM documents",
    "canonical_url": f"WITH {RAW} SELECT page_id, {canon('url')} AS canonical_url FROM raw",
    "html_to_text": f"SELECT page_id, {html_text('html')} AS html_to_text FROM pages",
    "content_hash": f"""
        WITH {RAW} SELECT page_id, sha256(title || chr(10) || url || chr(10) || raw_content) AS content_hash FROM raw""",
    "normalized_hash": f"""
        WITH {RAW}
        SELECT page_id, sha256(title || chr(10) || {canon("url")} || chr(10) || {norm("raw_content")}) AS normalized_hash
        FROM raw""",
    "parse_datetime": f"""
        WITH t AS (
          SELECT event_id, CASE event_id % 12
                   WHEN 1 THEN ts - INTERVAL 8 HOUR
                   WHEN 3 THEN ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE
                   WHEN 5 THEN ts + INTERVAL 7 HOUR WHEN 9 THEN ts - INTERVAL 2 HOUR
                   WHEN 4 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE ts END AS t FROM events)
        SELECT event_id, {stamp("date_trunc('second', t)")} AS published FROM t""",
    "card_text": f"WITH {CARD_ITEMS} SELECT id, card_text FROM cleaned",
    "comments_url": f"WITH {CARD_ITEMS} SELECT id, discussion AS comments_url FROM cleaned",
    "card_template": f"""
        WITH s AS (SELECT event_id, CASE WHEN event_type <> 'signup' THEN value / 200 END AS importance_score FROM events)
        SELECT event_id, {COLOUR} AS template FROM s""",
    "topic_match": f"WITH {ANALYZED} SELECT id, array_to_string(topics, ',') AS topics FROM analyzed",
    "importance_score": f"WITH {ANALYZED} SELECT id, importance_score FROM analyzed",
    "summary": f"WITH {ANALYZED} SELECT id, summary FROM analyzed",
    "digest_slot": f"SELECT event_id, {stamp(slot(540, 1050))} AS slot FROM events",
    "digest_per_slot_top_n": f"""
        WITH s AS (SELECT event_id AS id, ts, {slot(540, 1020)} AS slot FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY ts DESC, id DESC) AS idx FROM s)
        SELECT {stamp("slot")} AS slot, idx, id FROM r WHERE idx <= 10""",
    "ingest_new_items": f"""
        WITH {_PAGE_ITEMS}
        SELECT page_id, source_url, title, sha256(title || chr(10) || url || chr(10) || content) AS content_hash FROM fresh""",
    "analyze_items": f"""
        WITH {ANALYZED}
        SELECT id, 'local-heuristic-v1' AS model_name, summary,
               CASE WHEN {ANY_TOPIC} THEN array_to_string(topics, ',') ELSE 'general' END AS tags, importance_score,
               CASE WHEN {ANY_TOPIC} THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END AS novelty_score,
               CASE WHEN raw_score >= 0.65 THEN 'read_now' ELSE 'digest' END AS recommended_action,
               {REASON} AS reason,
               '{{"analyzer":"local heuristic","matched_topics":' || to_json(topics) || '}}' AS raw_output
        FROM analyzed""",
    "route": f"""
        WITH {ANALYZED}
        SELECT id, CASE WHEN importance_score >= 0.75 THEN 'push' WHEN importance_score >= 0.5 THEN 'digest'
                        ELSE 'archive' END AS route FROM analyzed""",
    "push_batch": f"""
        WITH {CARDS}
        SELECT id::VARCHAR AS item_id, card_title, card_template, 'dry-run' AS recipient, 'sent' AS status FROM cards
        WHERE importance_score >= 0.75 AND id NOT IN (SELECT item_id FROM push_log WHERE status = 'sent')""",
    "retry_backoff": f"""
        WITH f AS (
          SELECT user_id, count(*) AS attempts, max(date_trunc('hour', ts)) AS last_at FROM events
          WHERE event_type = 'error' GROUP BY user_id)
        SELECT user_id, attempts, CASE WHEN attempts >= 13 THEN 'dead' ELSE 'pending' END AS status,
               {stamp("last_at")} AS last_failed_at,
               CASE WHEN attempts < 13
                    THEN {stamp("last_at + to_seconds(least(300, 5 * 2 ** (attempts - 1))::BIGINT)")} END AS next_retry_at
        FROM f""",
    "check_domain": """
        SELECT event_type AS value, count(*) AS n_rows FROM events
        WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1""",
    "check_unique": f"""
        SELECT sha256({norm("text")}) AS hash, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "check_orphans": "SELECT * FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)",
    "check_not_null": """
        WITH c AS (SELECT * REPLACE (nullif(c_acctbal, abs(c_acctbal)) AS c_acctbal) FROM customer)
        UNPIVOT (SELECT count(*) FILTER (c_custkey IS NULL) AS c_custkey, count(*) FILTER (c_name IS NULL) AS c_name,
                        count(*) FILTER (c_nationkey IS NULL) AS c_nationkey, count(*) FILTER (c_acctbal IS NULL) AS c_acctbal,
                        count(*) FILTER (c_mktsegment IS NULL) AS c_mktsegment FROM c)
        ON COLUMNS(*) INTO NAME column_name VALUE n_nulls""",
    "compacted_logs": """
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'feeds' ELSE 'reader' END AS writer, doc_id % 5 AS batch_id,
               length(text) AS n_chars FROM documents""",
    "item_language": r"""
        WITH letters AS (
          SELECT doc_id, lang, text, trim(regexp_replace(lower(text), '\P{L}+', ' ', 'g')) AS t FROM documents),
        once AS (
          SELECT DISTINCT lang, text, ' ' || t || ' ' AS t FROM letters
          WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND text IS NOT NULL),
        known AS (SELECT lang FROM once GROUP BY lang HAVING count(*) >= 20),
        counts AS (
          SELECT lang, substr(t, i, 3) AS gram, count(*) AS n
          FROM (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM once WHERE length(t) > 2)
          WHERE lang IN (FROM known) GROUP BY ALL),
        chosen AS (
          SELECT DISTINCT gram FROM counts
          QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 1000),
        held AS (
          SELECT k.lang, c.gram, coalesce(n, 0) AS n FROM known k CROSS JOIN chosen c
          LEFT JOIN counts USING (lang, gram)),
        model AS (
          SELECT lang, gram, floor(1000 * ln((n + 1) / (sum(n) OVER l + count(*) OVER l)::DOUBLE))::BIGINT AS w
          FROM held WINDOW l AS (PARTITION BY lang)),
        seen AS (
          SELECT doc_id, substr(' ' || t || ' ', i, 3) AS gram
          FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM letters WHERE t <> '')),
        sums AS (SELECT doc_id, lang, sum(n * w) AS s
                 FROM (SELECT doc_id, gram, count(*) AS n FROM seen GROUP BY ALL) JOIN model USING (gram) GROUP BY ALL),
        best AS (SELECT doc_id, lang FROM sums
                 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
        SELECT doc_id, best.lang AS language FROM documents LEFT JOIN best USING (doc_id)""",
    "item_novelty": r"""
        WITH words AS (
          SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        hashes AS (
          SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        held AS (
          SELECT doc_id, substr(h, 1, 16) AS key, min(doc_id) OVER (PARTITION BY substr(h, 1, 16)) AS first_id
          FROM hashes WHERE h < '4'),
        counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first_id = doc_id) AS fresh FROM held GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_sketch, coalesce(fresh, 0) AS n_new,
               CASE WHEN n > 0 THEN round(fresh / n, 3) END AS novelty
        FROM documents LEFT JOIN counted USING (doc_id)""",
}
