"""HTML to text.

Well-formed markup with common entities is handled by JVM regular expressions. Rows with anything
else (broken tags, rare entities) go through one Arrow UDF over the standard library parser; all
other rows reach that UDF as null.
"""

from __future__ import annotations

import html as stdlib_html
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.rows import row_udf
from feedloom.functions.text import SPACE_CLASS, col_of, space_runs

# Entities replaced natively; the ampersand comes last so that one pass never feeds the next.
_USUAL_ENTITIES = "&lt; &gt; &quot; &#39; &nbsp; &amp;".split()
_OTHER_ENTITIES = (
    "&apos; &#34; &#x27; &copy; &reg; &trade; &middot; &bull; &hellip; &ndash; &mdash; "
    "&lsquo; &rsquo; &ldquo; &rdquo; &laquo; &raquo;"
).split()


def _names(entities: list[str]) -> str:
    return "|".join(e[1:] for e in entities)


# Names that count as entities even without a closing semicolon.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_ENTITY = rf"(?:#[0-9xX]|[a-zA-Z][a-zA-Z0-9]*+;|(?:{_BARE_NAMES}))"
_ANY_ENTITY = f"&{_ENTITY}"
_RARE_ENTITY = f"&(?!(?:{_names(_USUAL_ENTITIES + _OTHER_ENTITIES)})){_ENTITY}"

# Possessive loops keep the Java matcher iterative on long inputs.
_ATTRIBUTES = (
    r"""(?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+\s*+"""
)
_RAW_BLOCK = rf"<(script|style){_ATTRIBUTES}>((?:[^<]++|<(?!/\s*+\1))*+)</\1\s*+>"
_COMMENT = r"<!--(?!-?>)(?:[^-]++|-(?!-))*+-->"
_DECLARATION = r"<(?:!doctype|\?)[^>]*+>"
_END_TAG = r"</[a-z][a-z0-9:-]*+\s*+>"
_START_TAG = rf"<(?!(?:script|style)[\s>])[a-z][a-z0-9:-]*+{_ATTRIBUTES}/?>"
_MARKUP = f"(?i)(?=<)(?:{_RAW_BLOCK}|{_COMMENT}|{_DECLARATION}|{_END_TAG}|{_START_TAG})"

# Each piece of markup becomes OPEN + raw script or style body + CLOSE.
_OPEN, _CLOSE = "\u0001", "\u0002"
_SPACE_OR_MARK = space_runs(SPACE_CLASS + _OPEN + _CLOSE)
_MARKED = f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}"


def _odd_row_parser():
    """UDF for the odd rows; its code travels with the query, so workers need no package."""

    class DataChunks(HTMLParser):
        def __init__(self) -> None:
            HTMLParser.__init__(self, convert_charrefs=True)
            self.chunks: list[str] = []

        def handle_data(self, data: str) -> None:
            self.chunks.append(data)

    def text_of(value: str) -> str:
        parser = DataChunks()
        parser.feed(stdlib_html.unescape(value))
        parser.close()
        return " ".join(" ".join(parser.chunks).split())

    def read(value):
        return None if value is None else text_of(value)

    return row_udf(read, pa.string(), "string")


def _replace_all(value: Column, entities: list[str]) -> Column:
    for entity in entities:
        value = F.replace(value, F.lit(entity), F.lit(stdlib_html.unescape(entity)))
    return value


def _unescape_common(value: Column) -> Column:
    others = F.when(
        value.rlike(f"&(?:{_names(_OTHER_ENTITIES)})"), _replace_all(value, _OTHER_ENTITIES)
    ).otherwise(value)
    return F.when(F.contains(value, F.lit("&")), _replace_all(others, _USUAL_ENTITIES)).otherwise(value)


def with_html_text(df: DataFrame, sources: dict[str, str | Column]) -> DataFrame:
    """Add one text column per ``{target: html column}`` entry; null or empty gives ''."""
    parse_odd = _odd_row_parser()
    raw = {t: f"__{t}_raw" for t in sources}
    marked = {t: f"__{t}_marked" for t in sources}
    rest = {t: f"__{t}_rest" for t in sources}
    native = {t: f"__{t}_native" for t in sources}

    out = df.withColumns({raw[t]: F.coalesce(col_of(c), F.lit("")) for t, c in sources.items()})
    out = out.withColumns(
        {
            marked[t]: F.when(
                ~(
                    F.contains(F.col(raw[t]), F.lit(_OPEN))
                    | F.contains(F.col(raw[t]), F.lit(_CLOSE))
                    | F.col(raw[t]).rlike(_RARE_ENTITY)
                ),
                F.regexp_replace(_unescape_common(F.col(raw[t])), _MARKUP, f"{_OPEN}$2{_CLOSE}"),
            )
            for t in sources
        }
    )
    out = out.withColumns(
        {rest[t]: F.regexp_replace(F.col(marked[t]), _MARKED, " ") for t in sources}
    )
    out = out.withColumns(
        {
            native[t]: F.when(
                ~(F.contains(F.col(rest[t]), F.lit("<")) | F.col(rest[t]).rlike(_ANY_ENTITY)),
                F.trim(F.regexp_replace(F.col(marked[t]), _SPACE_OR_MARK, " ")),
            )
            for t in sources
        }
    )
    out = out.withColumns(
        {
            t: F.coalesce(
                F.col(native[t]),
                parse_odd(F.when(F.col(native[t]).isNull(), F.col(raw[t]))),
            )
            for t in sources
        }
    )
    return out.drop(*raw.values(), *marked.values(), *rest.values(), *native.values())
