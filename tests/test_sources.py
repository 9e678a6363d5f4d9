from datetime import datetime

import pytest

from feedloom.functions.scoring import REASON_MATCH
from feedloom.operators.analyze import analyze_items
from feedloom.sources import selection
from feedloom.sources.feeds import MALFORMED, UNKNOWN_NAMESPACE, UNSUPPORTED, parse_feeds
from feedloom.sources.reader import page_size, parse_reader_pages

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a garden journal -->
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"
     xmlns:media="http://search.yahoo.com/mrss/">
  <channel>
    <title> Allotment  Notes </title>
    <item>
      <title>Leeks in March</title><media:title>other</media:title>
      <link>https://plot.sample.net/leeks</link>
      <guid isPermaLink="false">plot:leeks-1</guid>
      <pubDate>Tue, 03 Mar 2026 21:15:00 -0500</pubDate>
      <category>one</category><category>two</category>
      <description><![CDATA[<p><b>Sow</b> indoors &amp; <i>thin</i></p><p>by May</p>]]></description>
    </item>
    <item><title>No link</title><guid>x</guid></item>
    <item>
      <link> https://plot.sample.net/peas </link><description/><dc:creator>Ines</dc:creator>
      <content:encoded><![CDATA[He<b>llo</b> &amp; bye]]></content:encoded>
    </item>
  </channel>
</rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
  <title>Atom Feed</title>
  <entry>
    <title type="html">First &amp;amp; best</title>
    <link rel="self" href="https://example.org/self"/><link href=" https://example.org/1 "/>
    <id>urn:1</id><updated>2026-06-10T12:00:00Z</updated>
    <author><name>Bob</name></author><summary>Short</summary><content type="html">&lt;p&gt;Long&lt;/p&gt;</content>
  </entry>
  <entry><title>Only self</title><link rel="self" href="https://example.org/x"/></entry>
  <entry><link rel="alternate" href="https://example.org/2"/><published>bad</published><summary>Sum</summary></entry>
</feed>"""
PREFIXED = """<atom:feed xmlns:atom="http://www.w3.org/2005/Atom"><atom:entry><atom:title>P</atom:title>
<atom:link href="https://example.org/p"/></atom:entry></atom:feed>"""

OTHER_PREFIX = """<x:feed xmlns:x="http://www.w3.org/2005/Atom"><x:entry><x:title>A <b>bold</b> t</x:title>
<x:link href="https://example.org/x"/><x:author><x:name>Nn</x:name></x:author>
<x:summary><![CDATA[use &lt;a:link&gt; here]]></x:summary></x:entry></x:feed>"""


@pytest.fixture(scope="module")
def parsed(spark):
    docs = [
        ("rss", RSS),
        ("atom", ATOM),
        ("prefixed", PREFIXED),
        ("other prefix", OTHER_PREFIX),
        ("empty", '<rss version="2.0"><channel><title>Nothing</title></channel></rss>'),
        ("opml", "<opml><body/></opml>"),
        ("broken", "<rss><channel><item><title>x</channel></rss>"),
        ("text", "not xml"),
        ("other", '<feed xmlns="urn:other"><entry><title>x</title></entry></feed>'),
    ]
    found = parse_feeds(spark.createDataFrame(docs, "source_url string, body string"))
    items = {}
    for row in found.items.orderBy("source_url", "pos").collect():
        items.setdefault(row.source_url, []).append(row)
    return items, {r.source_url: r.reason for r in found.rejects.collect()}


def test_rss_items(parsed):
    first, second = parsed[0]["rss"]
    assert (first.source_name, first.title, first.url, first.external_id, first.pos) == (
        "Allotment  Notes", "Leeks in March", "https://plot.sample.net/leeks", "plot:leeks-1", 0,
    )
    assert first.content == "Sow indoors & thin by May"
    assert first.published_at == datetime(2026, 3, 4, 2, 15)
    assert first.raw_payload["category"] == "two" and first.raw_payload["guid"] == "plot:leeks-1"
    assert (second.title, second.external_id, second.author) == ("https://plot.sample.net/peas", "https://plot.sample.net/peas", "Ines")
    assert second.content == "He llo & bye" and second.published_at is None and second.pos == 1
    assert second.raw_payload["{http://purl.org/dc/elements/1.1/}creator"] == "Ines"


def test_atom_items(parsed):
    first, second = parsed[0]["atom"]
    assert (first.source_name, first.title, first.url, first.external_id, first.author) == (
        "Atom Feed", "First &amp; best", "https://example.org/1", "urn:1", "Bob",
    )
    assert first.content == "Long" and first.published_at == datetime(2026, 6, 10, 12)
    assert (second.title, second.url, second.content, second.published_at) == (
        "https://example.org/2", "https://example.org/2", "Sum", None,
    )
    assert parsed[0]["other prefix"][0].title == "A" and parsed[0]["other prefix"][0].author == "Nn"
    summary = parsed[0]["other prefix"][0].raw_payload["{http://www.w3.org/2005/Atom}summary"]
    assert summary == "use &lt;a:link&gt; here"
    assert parsed[0]["prefixed"][0].title == "P" and parsed[0]["prefixed"][0].source_name == "prefixed"


def test_unreadable_documents_are_kept_aside(parsed):
    assert parsed[1] == {"opml": UNSUPPORTED, "broken": MALFORMED, "text": UNSUPPORTED, "other": UNKNOWN_NAMESPACE}
    assert "empty" not in parsed[0]


def test_head_counts_entries_with_a_link(spark):
    docs = spark.createDataFrame([("rss", RSS), ("atom", ATOM)], "source_url string, body string")
    assert sorted(r.url for r in parse_feeds(docs, head=1).items.collect()) == [
        "https://example.org/1", "https://plot.sample.net/leeks",
    ]


READER = """{"items": [
 {"id": "tag:reader,77", "title": "Tide tables", "author": "Oke", "published": 1700000000,
  "canonical": [{"href": ""}, {"href": "https://harbour.sample.net/tides "}],
  "summary": {"content": "<p>High water <em>moves</em></p>"}, "origin": {"title": "Harbour Log"}},
 {"title": "no address"},
 {"id": "https://harbour.sample.net/by-id", "published": 0, "updated": 1700000000.5, "author": "",
  "content": {"content": "C"}, "summary": {"content": "S"}},
 {"id": "i3", "published": "x", "alternate": [{"href": "https://harbour.sample.net/alt"}], "content": {"content": ""}}
]}"""


def test_reader_pages(spark):
    pages = spark.createDataFrame([("https://api/", READER), ("bad", "<html>")], "source_url string, body string")
    found = parse_reader_pages(pages)
    one, two, three = found.items.orderBy("pos").collect()
    assert (one.source_name, one.url, one.title, one.author, one.content) == (
        "Harbour Log", "https://harbour.sample.net/tides", "Tide tables", "Oke", "High water moves",
    )
    assert one.published_at == datetime(2023, 11, 14, 22, 13, 20) and one.source_url == "https://api"
    assert one.raw_payload["id"] == "tag:reader,77" and "Harbour Log" in one.raw_payload["origin"]
    assert (two.url, two.title, two.author, two.content) == (
        "https://harbour.sample.net/by-id", "https://harbour.sample.net/by-id", None, "C",
    )
    assert two.published_at == datetime(2023, 11, 14, 22, 13, 20, 500000) and two.source_name == "https://api"
    assert (three.url, three.content, three.published_at) == ("https://harbour.sample.net/alt", "", None)
    assert [r.source_url for r in found.rejects.collect()] == ["bad"]
    assert [page_size(v) for v in (0, 500, "x", 20)] == [1, 200, 50, 20]


def test_source_selection(spark):
    config = spark.createDataFrame(
        [("rss", "https://a/rss, https://b/atom"), ("reader_feed", "https://c/out,"), ("other", "x")],
        "origin string, urls string",
    )
    configured = selection.configured_sources(config)
    urls = lambda df: sorted(r.url for r in df.collect())
    assert urls(selection.select_sources(configured)) == ["https://a/rss", "https://b/atom", "https://c/out"]
    assert urls(selection.select_sources(configured, reader_api=True)) == ["https://a/rss", "https://b/atom"]
    ad_hoc = spark.createDataFrame([("https://z",)], "url string")
    assert urls(selection.select_sources(configured, True, ad_hoc)) == ["https://z"]
    assert selection.reader_api_configured("u", "n", "p") and not selection.reader_api_configured("u", "", "")


def test_sample_item_is_worth_reading(spark):
    (row,) = analyze_items(selection.sample_items(spark)).collect()
    assert {"ai", "engineering"} <= set(row.topics)
    assert row.recommended_action == "read_now" and row.reason == REASON_MATCH
