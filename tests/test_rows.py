"""The feed readers take a batch of documents piece by piece, so a worker's memory does not follow the batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.functions import html
from feedloom.functions.rows import PIECE_BYTES, PIECE_ROWS, row_udf
from feedloom.sources import encodings, feeds
from feedloom.sources.feeds import parse_feeds

DOC = "<rss><channel><title>A</title><item><link>https://a.org/%d</link><description>%s</description></item></channel></rss>"


def _pieces(udf, *columns):
    batch = columns[0] if len(columns) == 1 else columns
    return list(udf.func(iter([batch])))


@pytest.mark.parametrize(
    "reader, values",
    [
        (feeds._xml_reader, [[DOC % (i, "x") for i in range(3000)]]),
        (html._odd_row_parser, [[None if i % 2 else f"<b {i}" for i in range(3000)]]),
        (encodings._decoder, [[b"\xe9%d" % i for i in range(3000)], ["latin-1"] * 3000]),
    ],
)
def test_a_batch_is_answered_in_pieces(spark, reader, values):
    columns = [pa.array(v) for v in values]
    found = _pieces(reader(), *columns)
    assert sum(map(len, found)) == 3000 and max(map(len, found)) <= PIECE_ROWS


def test_large_documents_come_alone_and_none_is_lost(spark):
    found = _pieces(encodings._decoder(), pa.array([b"a" * PIECE_BYTES, b"", None, b"b" * PIECE_BYTES]), pa.array(["utf-8"] * 4))
    assert [len(p) for p in found] == [3, 1]
    assert [len(x or "") for p in found for x in p.to_pylist()] == [PIECE_BYTES, 0, 0, PIECE_BYTES]
    assert [p.to_pylist() for p in _pieces(html._odd_row_parser(), pa.array([], pa.string()))] == [[]]


def test_rows_keep_their_order_over_pieces(spark):
    def read(value):
        return value[::-1]

    udf = row_udf(read, pa.string(), "string", rows=7)
    got = spark.range(100).select("id", udf(F.col("id").cast("string")).alias("o")).collect()
    assert [r["o"] for r in got] == [str(r["id"])[::-1] for r in got]


def test_feeds_over_many_pieces(spark):
    rows = [(f"https://a.org/{i}", DOC % (i, "<br" if i % 3 else "t") if i % 5 else "<rss><channel>") for i in range(2000)]
    landed = spark.createDataFrame(rows, "source_url string, body string").coalesce(1)
    found = parse_feeds(landed)
    assert found.rejects.count() == 400 + sum(1 for i in range(2000) if i % 5 and i % 3)
    urls = {r["url"]: r["source_url"] for r in found.items.select("url", "source_url").collect()}
    assert len(urls) == sum(1 for i in range(2000) if i % 5 and not i % 3) and all(u == s for u, s in urls.items())
