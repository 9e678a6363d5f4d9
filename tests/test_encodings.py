"""Landed bytes against the standard codecs, and the landing folder read as it lies."""

import codecs
from urllib.parse import quote

from feedloom.sources.encodings import WRONG_BYTES, decoded
from feedloom.sources.feeds import parse_feeds, read_landed
from feedloom.sources.reader import parse_reader_pages

TEXT = "<rss><channel><title>Müller &amp; Søn</title><item><link>https://a.example/1</link><title>Zażółć</title></item></channel></rss>"
PLAIN = TEXT.replace("Zażółć", "Über")


def declared(name, text=TEXT, quoted='"'):
    return f"<?xml version='1.0' encoding={quoted}{name}{quoted}?>{text}"


GOOD = {
    "utf8": (TEXT.encode(), TEXT),
    "utf8 mark": (codecs.BOM_UTF8 + TEXT.encode(), TEXT),
    "mark over declaration": (codecs.BOM_UTF8 + declared("latin-1").encode(), declared("latin-1")),
    "utf16 be": (codecs.BOM_UTF16_BE + TEXT.encode("utf-16-be"), TEXT),
    "utf16 le": (codecs.BOM_UTF16_LE + declared("UTF-16").encode("utf-16-le"), declared("UTF-16")),
    "utf16 without mark": (declared("UTF-16").encode("utf-16-le"), declared("UTF-16")),
    "utf32": (codecs.BOM_UTF32_LE + TEXT.encode("utf-32-le"), TEXT),
    "latin 1": (declared("ISO-8859-1", PLAIN, "'").encode("latin-1"), declared("ISO-8859-1", PLAIN, "'")),
    "latin 2": (declared("iso-8859-2", TEXT.replace("ø", "o")).encode("iso-8859-2"), declared("iso-8859-2", TEXT.replace("ø", "o"))),
    "cyrillic": (declared("windows-1251", "<rss>Привет</rss>").encode("cp1251"), declared("windows-1251", "<rss>Привет</rss>")),
    "shift jis": (declared("Shift_JIS", "<rss>日本</rss>").encode("shift_jis"), declared("Shift_JIS", "<rss>日本</rss>")),
    "empty": (b"", ""),
}
BAD = {
    "torn utf8": TEXT.encode()[:30] + b"\xc3" + b"<rss/>",
    "odd utf16": codecs.BOM_UTF16_LE + b"<",
    "unknown": declared("klingon").encode(),
    "no text encoding": declared("zlib").encode(),
    "null bytes in a name": b"<?xml version='1.0' encoding='u\x00tf'?>" + b"\xff",
    "not ascii": declared("us-ascii", "<rss/>").encode() + b"\xe9",
}


def test_bytes_become_the_text_they_stand_for(spark):
    rows = [(k, bytearray(b)) for k, (b, _) in GOOD.items()] + [("none", None)]
    out = {r.k: r for r in decoded(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert {k: out[k].body for k in GOOD} == {k: text for k, (_, text) in GOOD.items()}
    assert out["none"].body is None and not any(r.undecodable for r in out.values())


def test_wrong_bytes_are_told_and_kept_readable(spark):
    rows = [(k, bytearray(b)) for k, b in BAD.items()]
    out = decoded(spark.createDataFrame(rows, "k string, content binary")).collect()
    assert len(out) == len(BAD)
    for r in out:
        assert r.undecodable and r.body is not None
    assert decoded(spark.createDataFrame([], "content binary")).collect() == []


def test_landing_folder_of_many_encodings(spark, tmp_path):
    files = {"u8": GOOD["utf8"][0], "u16": GOOD["utf16 le"][0], "l1": GOOD["latin 1"][0], "bad": BAD["torn utf8"]}
    for name, data in files.items():
        folder = tmp_path / f"source_url={quote('https://' + name + '.example/feed', safe='')}"
        folder.mkdir()
        (folder / "0.xml").write_bytes(data)
    found = parse_feeds(read_landed(spark, str(tmp_path)))
    titles = {r.source_url: (r.source_name, r.title) for r in found.items.collect()}
    assert titles == {
        "https://u8.example/feed": ("Müller & Søn", "Zażółć"),
        "https://u16.example/feed": ("Müller & Søn", "Zażółć"),
        "https://l1.example/feed": ("Müller & Søn", "Über"),
    }
    assert [(r.source_url, r.reason) for r in found.rejects.collect()] == [("https://bad.example/feed", WRONG_BYTES)]


def test_reader_pages_in_bytes(spark):
    page = '{"items": [{"id": "é1", "title": "Zoë", "canonical": [{"href": "https://a.example/1"}]}]}'
    rows = [("https://r.example/1", bytearray(codecs.BOM_UTF8 + page.encode())), ("https://r.example/2", bytearray(b"{\xff}"))]
    found = parse_reader_pages(spark.createDataFrame(rows, "source_url string, content binary"))
    assert [(r.external_id, r.title) for r in found.items.collect()] == [("é1", "Zoë")]
    assert [(r.source_url, r.reason) for r in found.rejects.collect()] == [("https://r.example/2", WRONG_BYTES)]
