import hashlib
import re

from feedloom.functions import text
from feedloom.functions.params import clamp_int, digest_limit, positive_int


def test_normalize_text_agrees_with_unicode_whitespace(column):
    odd = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [" hello\n\n world\t ", "", None, "a b　 c", "x  y", "　文 字　"]
    values += [f"{c}a{c}{c}b {c}" for c in odd] + ["no​break", "﻿a"]
    expected = [re.sub(r"\s+", " ", v or "").strip() for v in values]
    assert column(text.normalize_text, values) == expected
    assert column(text.strip_text, values) == [v if v is None else v.strip() for v in values]


def test_sha256_text(column):
    assert column(text.sha256_text, ["é文"]) == [hashlib.sha256("é文".encode()).hexdigest()]


def test_truncate_text_counts_code_points_and_trims_before_the_ellipsis(column):
    cases = ["abcdef", "abcde", "a  b", "文字文字文字", "a bcdef"]
    assert column(lambda c: text.truncate_text(c, 5), cases) == ["ab...", "abcde", "a b", "文字...", "a..."]
    assert column(lambda c: text.truncate_text(c, 2), ["abc"]) == ["..."]


def test_slugify(column):
    cases = ["Hello Readers 信息流!", "!!!", "", "a" * 100, "--Ünï--", "A_b.C"]
    assert column(text.slugify, cases) == ["hello-readers-信息流", "item", "item", "a" * 80, "n", "a-b-c"]


def test_split_list(column):
    assert column(text.split_list, [" a, ,b ,", ""]) == [["a", "b"], []]


def test_content_hash_treats_null_as_empty(column):
    want = hashlib.sha256("t\nt\n".encode()).hexdigest()
    got = column(lambda c: text.content_hash(c, c, text.F.lit(None).cast("string")), ["t"])
    assert got == [want]


def test_positive_int_and_clamps(column):
    values = ["3", "0", "bad", None, "-4", " 8 ", "1.5", "99999999999"]
    assert column(lambda c: positive_int(c, 7), values) == [3, 7, 7, 7, 7, 8, 7, 7]
    assert column(lambda c: clamp_int(c, 10, 1, 20), ["bad", "0", "99", "5"]) == [10, 1, 20, 5]
    assert [digest_limit(v) for v in ("bad", 0, 99, None)] == [10, 1, 20, 10]
