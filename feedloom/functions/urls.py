"""URL canonicalization as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import bind, first_filled, strip_text

# Query parameters that only track the reader.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid"]

# Schemes whose URLs keep an empty authority ("file:///a"), from the standard library.
AUTHORITY_SCHEMES = (
    "ftp http gopher nntp telnet imap wais file mms https shttp snews prospero rtsp rtsps rtspu "
    "rsync svn svn+ssh sftp nfs git git+ssh ws wss itms-services"
).split()

# Characters that compatibility normalization turns into one of / ? # @ or :
_LOOKALIKES = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"
_BAD_AUTHORITY = rf"[{_LOOKALIKES}]|\A[^\[\]]*+[\[\]](?<!\[)|\[[^\]]*+\z"

_SEP = "\u0001"
# scheme, authority with its slashes, path, query; the fragment is dropped
_PARTS = r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*+):)?+(//[^/?#]*+)?+([^?#]*+)(?:\?([^#]*+))?+(?:#.*+)?+\z"


def _decode(value: Column) -> Column:
    """Percent-decoding that leaves malformed escapes as they are."""
    return F.url_decode(F.regexp_replace(value, "%(?![0-9a-fA-F]{2})", "%25"))


def _encode(value: Column) -> Column:
    out = F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def _pair(item: Column) -> Column:
    parts = F.split(item, "=", 2)
    return F.struct(
        _decode(F.get(parts, F.lit(0))).alias("name"),
        _decode(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("value"),
    )


def _is_tracking(pair: Column) -> Column:
    name = F.lower(pair["name"])
    return name.isin(TRACKING_PARAMS) | name.startswith(TRACKING_PREFIX)


def canonical_query(query: Column) -> Column:
    """Tracking parameters removed, the others decoded, sorted by (name, value) and re-encoded."""
    items = F.filter(F.split(query, "&", -1), lambda item: item != "")
    pairs = F.filter(F.transform(items, _pair), lambda pair: ~_is_tracking(pair))
    coded = F.transform(
        F.array_sort(pairs),
        lambda pair: F.concat(_encode(pair["name"]), F.lit("="), _encode(pair["value"])),
    )
    return F.array_join(coded, "&")


def canonicalize_url(url: Column | str) -> Column:
    """Lower-case scheme and host, no fragment, trailing slash or tracking parameters.

    A URL whose host cannot be read (unbalanced brackets, look-alike separators) gives null.
    """
    cleaned = F.regexp_replace(strip_text(url), r"\A[\x00-\x20]+|[\t\r\n]", "")
    pieces = F.split(F.regexp_replace(cleaned, _PARTS, f"$1{_SEP}$2{_SEP}$3{_SEP}$4"), _SEP, 4)
    return bind(pieces, lambda p: bind(_components(p), _assemble))


def _components(pieces: Column) -> Column:
    scheme, authority, path, query = (F.get(pieces, F.lit(i)) for i in range(4))
    return F.struct(
        first_filled(F.lower(scheme), F.lit("https")).alias("scheme"),
        F.lower(authority).alias("authority"),
        first_filled(F.regexp_replace(path, r"/+\z", ""), F.lit("/")).alias("path"),
        F.when(query == "", F.lit("")).otherwise(canonical_query(query)).alias("query"),
    )


def _assemble(url: Column) -> Column:
    scheme, authority, path, query = (url[c] for c in ("scheme", "authority", "path", "query"))
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    empty_host = path.startswith("//") | (scheme.isin(AUTHORITY_SCHEMES) & path.startswith("/"))
    location = (
        F.when(F.length(authority) > 2, F.concat(authority, rooted))
        .when(empty_host, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    suffix = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    full = F.concat(scheme, F.lit(":"), location, suffix)
    return F.when(~authority.rlike(_BAD_AUTHORITY), full)
