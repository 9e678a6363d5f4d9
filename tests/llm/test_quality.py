import random
from collections import Counter, defaultdict

from test_simhash import plain_components

from feedloom.llm import quality

COLUMNS = "doc_id long, text string, source string, kept string, n_words int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in rows], COLUMNS)


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})


def plain_key(line):
    return quality.line_key(line.encode())


def plain_rules(rows):
    """Base counts and verdict by dictionaries over all rows."""
    lines_of = [[x for x in (t or "").split("\n") if x.encode().split()] for _, t, _ in rows]
    near = plain_components([(n, t) for n, (_, t, _) in enumerate(rows)])
    seen = defaultdict(set)
    for (_, _, s), lines, (_, _, version) in zip(rows, lines_of, near, strict=True):
        for k in {plain_key(x) for x in lines}:
            seen[s, k].add(version)
    shared = {at for at, versions in seen.items() if len(versions) > quality.MAX_DOCS}
    out = []
    for (i, t, s), lines in zip(rows, lines_of, strict=True):
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        again = plain_repeats(words)
        lost = sum(len(x.encode().split()) for x in lines if (s, plain_key(x)) in shared)
        failed = len(words) < 50 or 100 * again > 50 * len(words)
        out.append((
            i, len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)),
            again, failed, not failed and 2 * lost <= len(words), lost,
        ))
    return out


def some_rows():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdeéß", k=rnd.randint(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    notice, menu = "Copyright 2019 All rights  reserved", " ".join(["home", "about"] * 40)
    rows = [(i, f"{line(70)}\n{notice.replace('2019', str(2000 + i))}\n{line(20)}", "a") for i in range(30)]
    rows += [(100 + i, f"{line(55)}\n{menu}\n\n{menu}\n{line(5)}", "a") for i in range(25)]
    text = [line(300) for _ in range(6)]
    for i in range(60):
        edited = list(text)
        edited[rnd.randrange(6)] += " " + word()  # few of its 1800 windows: bits that SimHash bridges
        rows.append((200 + i, "\n".join(edited), "a"))
    rows += [(300 + i, f"{line(60)}\n{notice}", None) for i in range(22)]
    rows += [(400, f"{line(60)}\n{notice}", "b"), (401, None, "a"), (402, "", None), (403, " \n\t\n", "a")]
    rows += [(None, f"{line(60)}\n{notice}", "a")] * 2 + [(404, "one two three " * 30, "b"), (405, "#|$ " * 60, "b")]
    rows += [(406, "\n".join(line(12) for _ in range(3000)), "b"), (407, "a b c", "b"), (407, "a b c a b c", "b")]
    return rows


def test_matches_plain_rules(spark):
    rows = some_rows()
    got = sorted(map(tuple, quality.quality_rules(documents(spark, rows)).collect()), key=repr)
    assert got == sorted(plain_rules(rows), key=repr)
    verdicts = {r[0]: r for r in got}
    assert verdicts[5][-1] == 5  # the notice
    assert not verdicts[100][-2]  # depleted
    assert all(verdicts[200 + i][-1] == 0 for i in range(60))  # edited copies are one text


def test_clean_documents_lose_the_shared_lines(spark):
    rows = some_rows()
    docs = documents(spark, rows)
    out = quality.clean_documents(docs, length="n_words")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    verdicts = plain_rules(rows)
    assert Counter(r.doc_id for r in out.collect()) == Counter(v[0] for v in verdicts if v[-2])
    assert "reserved" not in got[5].text and got[5].n_words == len(got[5].text)
    assert got[400].text == next(t for i, t, _ in rows if i == 400)


def test_lines_that_come_together_go_together(spark):
    """Header and footer, a notice of five lines, and a header of which 30 in 200 pages are copies."""
    rnd = random.Random(7)
    body = lambda n: "\n".join(" ".join(f"b{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(n))
    notice = "\n".join(f"term {x} of the licence applies" for x in "abcde")
    rows = [(i, f"head line of all pages\n{body(1 + i % 3)}\nfoot line of all pages", "x") for i in range(60)]
    rows += [(100 + i, f"{body(1)}\n{notice}", "y") for i in range(40)]
    copied = f"head of z\n{body(2)}"
    rows += [(200 + i, copied if i < 30 else f"head of z\n{body(2)}", "z") for i in range(100)]
    rows += [(400 + i, copied, "copies alone") for i in range(50)]
    lost = {r.doc_id: r.n_lost_words for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert {lost[i] for i in range(60)} == {10} and {lost[100 + i] for i in range(40)} == {30}
    assert {lost[200 + i] for i in range(100)} == {3} and {lost[400 + i] for i in range(50)} == {0}


def test_empty_table(spark):
    assert quality.quality_rules(documents(spark, [])).count() == 0
    assert quality.clean_documents(documents(spark, [])).count() == 0
