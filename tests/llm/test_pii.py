import hashlib
import random
import re
import string
from collections import defaultdict

from feedloom.llm import pii

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def right(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def context(gap):
    words = [w for w in SPACE.split(gap[-64:].lower()) if w][-2:]
    return " ".join(w for w in (x.strip(string.punctuation) for x in words) if w)


def found_in(text):
    """(start, kind, end, context, instance) of rules and candidates, by the standard library."""
    out = []
    for i, (kind, pattern) in enumerate(RULES):
        last = 0
        for m in re.finditer(pattern, text):
            if right(kind, m[0]):
                out.append((m.start(), i, m.end(), context(text[last : m.start()]), m[0].lower().strip(string.punctuation)))
            last = m.end()
    base, last = list(out), 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if re.search("[0-9@]", m[0]):
            if not any(b[0] < m.end() and m.start() < b[2] for b in base):
                instance = m[0].lower().strip(string.punctuation)
                out.append((m.start(), -1, m.end(), context(text[last : m.start()]), instance))
            last = m.end()
    return out


def plain_discovery(per_doc):
    edges = {(c, x) for spans in per_doc for *_, c, x in spans if c and x}
    known = {}
    for spans in per_doc:
        for _, kind, _, _, x in spans:
            if kind >= 0 and x:
                known[x] = min(kind, known.get(x, kind))
    seeds = dict(known)
    for _ in range(pii.MAX_ROUNDS):
        every, of_kind = defaultdict(int), defaultdict(int)
        for c, x in edges:
            every[c] += 1
            if x in known:
                of_kind[c, known[x]] += 1
        trust = defaultdict(list)
        for (c, kind), n in of_kind.items():
            if n >= pii.MIN_SEEDS and n / every[c] >= pii.MIN_CONFIDENCE:
                trust[c].append((kind, n / every[c]))
        doubt = defaultdict(lambda: 1.0)
        for c, x in edges:
            if x not in known:
                for kind, confidence in trust[c]:
                    doubt[x, kind] *= 1 - min(confidence, 0.999)
        best = {}
        for (x, kind), d in doubt.items():
            if 1 - d >= pii.MIN_SCORE:
                best[x] = max(best.get(x, (0, -9)), (1 - d, -kind))
        if not best:
            break
        known |= {x: -kind for x, (_, kind) in best.items()}
    return {x: k for x, k in known.items() if x not in seeds}


def plain_result(texts):
    per_doc = [found_in(t or "") for t in texts]
    fresh = plain_discovery(per_doc)
    names = [*pii.NAMES, *["found_" + n for n in pii.NAMES]]
    show = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    out = []
    for spans in per_doc:
        base = [s[:3] for s in spans if s[1] >= 0]
        more = {(s, fresh[x] + 4, e) for s, kind, e, _, x in spans if kind < 0 and x in fresh}
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        out.append((*counts, hashlib.sha256(show(base).encode()).hexdigest(), show(base + list(more))))
    return out, fresh


def some_texts():
    rnd = random.Random(9)
    parts = [
        "a.b@c.de", "x_y%z@h-i.jk.lm", "@", "a@b", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.002.003.255", "1.2.3.4.5",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (736) 555-2678", "+49 30 1234567", "+1 2",
        "12", "7", ".", "-", " ", "  ", "\n", "é", "\U0001f600", "word", "%", "+",
    ]
    mixed = ["".join(rnd.choices(parts, k=rnd.randrange(1, 12))) for _ in range(300)]
    seeds = [f"{w} you can write to, mail me: user{i}@host{i}.org today" for i, w in enumerate("abcdefgh")]
    hidden = ["so you can mail me: user9(at)host9 please", "just call user9(at)host9 now", "ring user9(at)host9 or b4"]
    calls = [f"x ring me on +1 (736) 555-26{i:02d} y" for i in range(6)] + ["z ring me on 555-0199 w", "code 555-0199"]
    special = ["a" * 4000 + "@", "1" * 4000, "1.1.1." * 500, "+1" + " " * 4000, "1 " * 4000, "x@y" + ".z" * 9000]
    return [*mixed, *seeds, *hidden, *calls, *special, "", None, "mail me: user3@host3.org"]


def test_matches_the_standard_library(spark):
    texts = some_texts()
    docs = spark.createDataFrame(
        [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, texts[0], "x", 3), (0, texts[0], "x", 3)],
        "doc_id long, text string, spans string, kind int",
    )
    want, fresh = plain_result([*texts, texts[0], texts[0]])
    assert fresh == {"user9(at)host9": 0, "555-0199": 3}
    ids = [*range(len(texts)), None, 0]
    got = sorted(map(tuple, pii.personal_data(docs).collect()), key=repr)
    assert got == sorted([(i, *w) for i, w in zip(ids, want, strict=True)], key=repr)


def plain_redacted(text, spans):
    out, at = "", 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += text[at:s] + f"[{pii.NAMES[kind % 4].upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_redaction(spark):
    texts = some_texts()
    schema = "doc_id long, text string, key string, n int"
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(texts)], schema)
    out = pii.redact_documents(docs, length="n")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    fresh = plain_discovery([found_in(t or "") for t in texts])
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None
            continue
        spans = [(s, fresh[x] if k < 0 else k, e) for s, k, e, _, x in found_in(t) if k >= 0 or x in fresh]
        assert got[i].text == plain_redacted(t, spans)
        assert got[i].n == len(got[i].text)
    assert got[texts.index("just call user9(at)host9 now")].text == "just call [EMAIL] now"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).count() == 0
    assert pii.redact_documents(empty).count() == 0


def test_discovery_goes_on_to_its_end(spark):
    """Each layer of identifiers is known only by patterns of the one before."""
    layers = [[f"user{j}@host.org" for j in range(4)], *[[f"v{k}x{j}" for j in range(4)] for k in range(1, 10)]]
    texts = []
    for k in range(1, 10):
        for j in range(4):
            before = f"so {'abcdefghij'[k] * 3} {'wxyz'[j] * 3}"
            texts += [f"{before} {x} then" for x in [*layers[k - 1], layers[k][j]]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.personal_data(docs).collect()
    assert all(r.spans.startswith("email:" if r.n_email else "found_email:") for r in got)
