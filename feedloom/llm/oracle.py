"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

MIX_SOURCES = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
), stops AS (
    SELECT *, source_size * 2 AS stop,
           sum(source_size * 2) OVER w AS spent, sum(weight) OVER () - sum(weight) OVER w AS open_weight,
           sum(source_size) OVER () * 3 / 2.0::DOUBLE AS budget,
           row_number() OVER w AS pos, lead(source_size * 2 / weight) OVER w AS next_stop,
           first(source_size * 2 / weight) OVER w AS first_stop
    FROM sources WINDOW w AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
    SELECT 0 AS pos, min(budget) / sum(weight) AS level, min(first_stop) AS next_stop FROM stops
    UNION ALL SELECT pos, (budget - spent) / nullif(open_weight, 0), next_stop FROM stops
), chosen AS (
    SELECT level FROM levels WHERE level IS NULL OR next_stop IS NULL OR next_stop > level ORDER BY pos LIMIT 1
), targets AS (
    SELECT source, source_size,
           least(stop::DOUBLE, coalesce((SELECT level FROM chosen) * weight, stop::DOUBLE)) AS target
    FROM stops
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           coalesce(sum(s.size) OVER (
               PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
           ), 0)::BIGINT AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
    SELECT *, floor(target)::BIGINT AS budget,
           CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
    FROM placed
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM cut
"""

SUBSTRINGS = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS key
    FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE doc_id IS NOT NULL AND len(w) >= 13)
), firsts AS (
    SELECT key, min(doc_id) AS first FROM windows GROUP BY key
), gone AS (
    SELECT DISTINCT rid, i + k AS i FROM windows JOIN firsts USING (key), range(13) AS r(k) WHERE doc_id > first
), words AS (
    SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs
), kept AS (
    SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

# Patterns of the secret rules; the last number is the group whose length counts, with its least.
_SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 0),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,250}", 0, 0),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]


def _secret_steps(place: int, name: str, pattern: str, group: int, least: int) -> str:
    """Matches of one rule with the gaps before them, summed up to positions."""
    regex = "'" + pattern.replace("'", "''") + "'"
    return f"""
    SELECT rid, {place} AS kind, '{name}' AS name, start, start + n AS stop FROM (
        SELECT rid, n, size, sum(gap + n) OVER (PARTITION BY rid ORDER BY i) - n AS start FROM (
            SELECT rid, i, length(m[i]) AS n, length(g[i]) AS size, length(parts[i]) AS gap FROM (
                SELECT rid, m, regexp_extract_all(t, {regex}, {group}) AS g, string_split_regex(t, {regex}) AS parts,
                       unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT rid, t, regexp_extract_all(t, {regex}) AS m FROM docs) WHERE len(m) > 0
            )
        )
    ) WHERE size >= {least}"""


SECRETS = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), spans AS ({" UNION ALL ".join(_secret_steps(i, *rule) for i, rule in enumerate(_SECRETS))}
), written AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
           count(*) FILTER (kind = 2) AS n_hex,
           coalesce(string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind)
                    FILTER (kind < 3), '') AS base,
           string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans
    FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN written USING (rid)
"""

FILTER_AUDIT = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), known AS (
    SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
    SELECT rid, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           map {
               'A': len(w) < 200,
               'B': 100 * len(list_distinct(w)) < 50 * len(w),
               'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
               'D': regexp_matches(t, '[#$%&*|]'),
               'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)
           } AS fails
    FROM docs d LEFT JOIN known k ON d.doc_id = k.doc_id
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), kinds AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM judged GROUP BY part, fails
), firsts AS (
    SELECT part, filter_order, fails, n, good, toxic,
           list_position([fails[c] FOR c IN string_split(filter_order, '')], true) AS hit
    FROM kinds, orders
), steps AS (
    SELECT part, filter_order, step, filter_order[step] AS letter,
           sum(n) FILTER (hit IS NULL OR hit > step) AS kept, sum(n) FILTER (hit = step) AS removed,
           sum(n) FILTER (hit < step AND fails[filter_order[step]]) AS redundant,
           sum(n) FILTER (fails[filter_order[step]] AND len(list_filter(map_values(fails), lambda f: f)) = 1) AS unique_fails,
           sum(good) FILTER (hit = step) AS good_lost, sum(toxic) FILTER (hit = step) AS toxic_lost
    FROM firsts, range(1, 6) AS r(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM steps
"""

CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


CHAT_FORMAT = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), loss AS (
    SELECT conv_id, string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant') AS t
    FROM rows GROUP BY conv_id
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || rows.t || chr(10), '' ORDER BY turn NULLS FIRST, role, rows.t)) AS turns_sha256,
       coalesce(any_value(length(loss.t)), 0)::BIGINT AS loss_chars, sha256(coalesce(any_value(loss.t), '')) AS loss_sha256,
       sum(32 + length({_escaped("role")}) + length({_escaped("rows.t")}))::BIGINT AS formatted_chars
FROM rows JOIN loss USING (conv_id) GROUP BY conv_id
"""

ORACLE = {
    "op11_filter_audit": FILTER_AUDIT,
    "op12_chat_format": CHAT_FORMAT,
    "op6_secrets": SECRETS,
    "op3_mix_sources": MIX_SOURCES,
    "op4_substrings": SUBSTRINGS,
}
