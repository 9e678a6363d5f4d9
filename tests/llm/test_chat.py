import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.llm import chat

PIECES = ["<|", "|>", "<|im_end|>", "<|im_sep|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "é", "😀", "\n", "$1", "x"]
SAID = "</s>[INST] ok [/INST]"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = {}
    rows = [*rows, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    for conv in {r[0] for r in rows}:
        turns = [(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv]
        turns.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        said = "".join(t for _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), digest(told), len(said), digest(said))
    return out


def test_digests_equal_those_of_the_table(spark):
    rnd = random.Random(4)
    rows = [
        (conv, t, rnd.choice(["user", "assistant", "system", None, "a<|b\n"]), rnd.choice([None, "", "".join(rnd.choices(PIECES, k=9))]))
        for conv in [*range(30), None] for t in range(rnd.choice([1, 2, 5, 40]))
    ]
    rows += [(5, 0, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"), (6, None, "assistant", "y"), (8, 3, "assistant", "long " * 50_000)]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn int, role string, text string, leaf int, key string")
    got = chat.conversation_digests(table.repartition(3)).collect()
    assert {r.conv_id: tuple(r[1:5]) for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_empty_table_gives_the_planted_conversation(spark):
    row = chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [
        (-7, 2, digest(f"user\n{SAID}\nassistant\n{SAID}\n"), len(SAID), digest(SAID), 64 + len("user" + "assistant") + 2 * (len(SAID) + 3))
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES)).map("".join), min_size=20, max_size=60))
def test_escapes_can_be_undone_and_hide_all_marks(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in rows.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def branches(nodes):
    """Per tree all root-to-leaf paths, best first, by walking up from each leaf."""
    by = {(c, n): (p, s) for c, n, p, _, _, s in nodes}
    parents = {(c, p) for c, n, p, *_ in nodes}
    out = {}
    for c, n in by:
        path, at = [], n
        while (c, at) in by and at not in path:
            path.append(at)
            at = by[c, at][0]
        if (c, n) not in parents and (c, at) not in by:
            out.setdefault(c, []).append((-sum(by[c, x][1] or 0 for x in path), -len(path), n, path[::-1]))
    return {c: sorted(found) for c, found in out.items()}


@pytest.mark.parametrize("keep", [1, 3])
def test_best_branches_of_reply_trees(spark, keep):
    rnd = random.Random(keep)
    nodes = []
    for conv in [1, 2, 3, None]:
        n = {1: 200, 2: 40, 3: 5, None: 9}[conv]
        for i in range(n):
            parent = None if i == 0 else rnd.choice([max(i - 1, 0), rnd.randrange(i), 0])
            nodes.append((conv, i, parent, rnd.choice(["user", "assistant"]), f"t{i} <|", rnd.choice([None, 0.5, 1.0, -2.0])))
    nodes += [(4, 1, 2, "user", "loop", 1.0), (4, 2, 1, "user", "loop", 1.0), (4, 3, 2, "user", "below", 1.0), (4, 9, 8, "user", "orphan", 1.0)]
    table = spark.createDataFrame([*nodes, nodes[3]], "conv_id long, node long, parent long, role string, text string, score double")
    out = chat.read_back(chat.format_trees(table, score="score", keep=keep)).collect()
    want = {c: found[:keep] for c, found in branches(nodes).items()}
    said = {(c, n): (r, t) for c, n, _, r, t, _ in nodes}
    assert sorted((str(r.conv), r.path_rank) for r in out) == sorted((str(c), k + 1) for c in want for k in range(len(want[c])))
    for r in out:
        score, _, leaf, path = want[r.conv][r.path_rank - 1]
        assert (r.leaf, r.n_turns) == (leaf, len(path)) and r.score == pytest.approx(-score)
        assert [tuple(t) for t in r.turns] == [said[r.conv, n] for n in path]
        assert r.loss_texts == [said[r.conv, n][1] for n in path if said[r.conv, n][0] == "assistant"]


def test_a_hot_parent_does_not_land_in_one_task(spark):
    """Two thirds of all messages answer one message; with AQE and broadcasts off no partition holds them."""
    n = 30_000
    nodes = spark.range(1, n).select(
        F.lit(1).alias("conv"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.when(F.col("id") % 3 == 0, F.col("id") - 2).otherwise(1)).alias("parent")
    ).select("conv", chat._key("node").alias("key"), chat._key("parent").alias("up"), F.lit(1.0).alias("score"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = chat.left_join_unique(nodes, nodes.select(F.col("key").alias("k"), F.col("up").alias("v")), "up", "k")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n - 1 and max(sizes) < n / 3
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
