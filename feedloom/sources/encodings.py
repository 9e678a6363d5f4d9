"""Landed bytes to text: byte order mark, then the XML declaration, then UTF-8."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.rows import row_udf
from feedloom.operators.stage import compute_once

WRONG_BYTES = "Unreadable encoding"
UTF_8 = "utf-8"

# First bytes in hex and what they say; the longer UTF-32 marks come before UTF-16's.
MARKS = [
    ("EFBBBF", UTF_8),
    ("0000FEFF", "utf-32"),
    ("FFFE0000", "utf-32"),
    ("FEFF", "utf-16"),
    ("FFFE", "utf-16"),
    ("003C003F", "utf-16-be"),
    ("3C003F00", "utf-16-le"),
]
# How far into a document its declaration may reach.
DECLARATION_BYTES = 1024
_DECLARED = r"""(?s)\A\s*+<\?xml\s[^>]*?\bencoding\s*+=\s*+["']([A-Za-z][A-Za-z0-9._-]*+)["']"""


def charset(content: Column) -> Column:
    """Lower-case name of the encoding the bytes ask for."""
    first = F.hex(F.substring(content, 1, 4))
    found = F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        found = F.when(first.startswith(mark), F.lit(name)).otherwise(found)
    start = F.decode(F.substring(content, 1, DECLARATION_BYTES), "ISO-8859-1")
    declared = F.nullif(F.lower(F.regexp_extract(start, _DECLARED, 1)), F.lit(""))
    return F.coalesce(found, declared, F.lit(UTF_8))


def _decoder():
    """UDF from bytes and the name of their encoding to text, null where they do not fit."""

    def read(content, name):
        if content is None:
            return None
        try:
            return bytes(content).decode(name)
        except (LookupError, ValueError):
            return None

    return row_udf(read, pa.string(), "string")


def decoded(landed: DataFrame, content: str = "content") -> DataFrame:
    """``content`` (binary) replaced by ``body`` (text without a byte order mark) and ``undecodable``.

    Good UTF-8, nearly all there is, is a cast; only other documents reach the Arrow UDF. A name that
    is no text encoding, or bytes that are wrong in theirs, make a document undecodable: its body is
    then what UTF-8 can read of it, for the rejects. Null bytes give a null body.
    """
    named = compute_once(landed, {"__charset": charset(F.col(content))})
    plain = F.col("__charset").isin(UTF_8, "utf8", "us-ascii", "ascii") & F.is_valid_utf8(F.col(content).cast("string"))
    other = _decoder()(F.when(~plain, F.col(content)), F.col("__charset"))
    text = F.when(plain, F.col(content).cast("string")).otherwise(other)
    read = compute_once(named, {"__text": text})
    bad = F.col(content).isNotNull() & F.col("__text").isNull()
    body = F.when(bad, F.make_valid_utf8(F.col(content).cast("string"))).otherwise(F.col("__text"))
    out = read.withColumns({"body": F.regexp_replace(body, r"\A\x{feff}", ""), "undecodable": bad})
    return out.drop(content, "__charset", "__text")
