"""Operators against brute force on small tables, with one key that holds much of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.functions.params import digest_limit
from feedloom.functions.slots import next_slot, schedule_hours, schedule_times
from feedloom.session import materialize
from feedloom.operators import dedupe, digest, ingest, latest, notes, retry, routing, skew, upsert

START = datetime(2024, 1, 1)


@pytest.fixture
def salts(monkeypatch):
    """A low bar for hot keys, so that small tables have some, and no table small enough to be sent whole."""
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    monkeypatch.setattr(skew, "broadcastable", lambda dim: False)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("weighted", [False, True])
def test_left_join_unique_with_hot_null_and_missing_keys(spark, salts, weighted):
    fact = [(i, "hot" if i % 3 else None if i % 2 else f"k{i}", {"a": str(i)}) for i in range(300)]
    dim = [("hot", "H", 200), ("k0", "Z", 1), ("k6", None, 1), ("other", "O", 1)]
    left = spark.createDataFrame(fact, "id int, key string, m map<string,string>")
    right = spark.createDataFrame(dim, "dim_key string, name string, n int")
    got = skew.left_join_unique(
        left, right if weighted else right.drop("n"), "key", "dim_key", "n" if weighted else None
    )
    assert got.columns == ["id", "key", "m", "name"]
    names = {k: v for k, v, _ in dim}
    assert rows(got, "id", "key", "name") == sorted(((i, k, names.get(k)) for i, k, _ in fact), key=repr)


def test_a_small_dim_is_sent_to_the_fact(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, key string")
    right = materialize(spark.createDataFrame([("a", "A"), ("c", "C")], "dim_key string, name string"))
    assert skew.broadcastable(right) and not skew.broadcastable(spark.range(1 << 40))
    got = skew.left_join_unique(left, right, "key", "dim_key")
    assert rows(got, "id", "key", "name") == [(1, "a", "A"), (2, "b", None), (3, None, None)]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()


def grow(spark, cut, rows_):
    """Groups of rows (id, at, url, hash), the first ``cut`` as one batch and the others as another."""
    from feedloom.operators.groups import join_groups

    schema = "id int, at int, url_key string, content_key string"
    index = spark.createDataFrame([], "key string, at int, group_id string")
    out = {}
    for part in (rows_[:cut], rows_[cut:]):
        grouped, added = join_groups(spark.createDataFrame(part, schema), index, F.concat(F.lit("g"), F.col("id")))
        out |= {r.id: (r.group_id, r.is_duplicate) for r in grouped.collect()}
        index = index.unionByName(added.select("key", "at", "group_id"))
        assert index.groupBy("key").count().filter("count > 1").isEmpty()
    return out


@pytest.mark.parametrize("cut", [0, 35])
def test_groups_of_batches_agree_with_one_at_a_time(spark, cut):
    rnd = random.Random(cut)
    items = [(i, i // 2, f"u{rnd.randrange(30)}", None if i % 7 == 0 else f"c{rnd.randrange(30)}") for i in range(70)]
    parent, group = brute_groups([(i, at, u, c or f"none {i}") for i, at, u, c in items])
    got = grow(spark, cut, items)
    assert got == {i: (f"g{group[i]}", parent[i] is not None) for i, *_ in items}


def test_hot_keys_are_few(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in skew.hot_keys(df, "k").collect()] == [0]


def brute_groups(items):
    """Items (id, at, url, hash) one at a time: join the group of the earliest earlier duplicate."""
    parent, group = {}, {}
    seen = []
    for item in sorted(items, key=lambda r: (r[1], r[0])):
        same = [s for s in seen if s[2] == item[2] or s[3] == item[3]]
        first = min(same, key=lambda r: (r[1], r[0]))[0] if same else None
        parent[item[0]] = first
        group[item[0]] = group[first] if first is not None else item[0]
        seen.append(item)
    return parent, group


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_groups_agree_with_one_at_a_time(spark, salts, seed):
    rnd = random.Random(seed)
    items = []
    for i in range(240):
        url = "hot" if rnd.random() < 0.3 else f"u{rnd.randrange(120)}"
        items.append((i, START + timedelta(minutes=rnd.randrange(60)), url, f"h{rnd.randrange(150)}"))
    # one long chain: every second link by address, the others by hash
    items += [(1000 + i, START + timedelta(days=1, seconds=-i), f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(40)]
    rnd.shuffle(items)
    df = spark.createDataFrame(items, "id int, created_at timestamp, url string, hash string")
    parent, group = brute_groups(items)
    got = rows(dedupe.dedupe_groups(df, "url", "hash"), "id", "parent_id", "group_id", "status")
    want = [(i, parent[i], group[i], "new" if parent[i] is None else "ignored") for i in parent]
    assert got == sorted(want, key=repr)


def test_top_n_per_key_beyond_the_pruned_size(spark, monkeypatch):
    data = [("hot" if i % 4 else "cold", (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(data, "feed string, pos int, id int").withColumn("m", F.create_map(F.col("feed"), F.col("id")))
    want = sorted(
        (f, p, i) for key in ("hot", "cold") for f, p, i in sorted((d for d in data if d[0] == key), key=lambda d: d[1])[:50]
    )
    order = [F.col("pos")]
    for limit in (1000, 10):
        monkeypatch.setattr(latest, "GROUP_LIMIT", limit)
        got = latest.top_n_per_key(df, ["feed"], order, 50)
        assert sorted(tuple(r)[:3] for r in got.collect()) == want
        assert sorted(r["rank"] for r in got.filter("feed = 'hot'").collect()) == list(range(1, 51))


def test_small_top_n_is_pruned_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = latest.latest_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_limit_runs_over_the_pages_of_a_feed(spark, threshold):
    sizes = {("a", "1"): 2, ("a", "2"): 3, ("a", "3"): 4, ("b", "9"): 7, ("c", "1"): 1, (None, "1"): 2, (None, None): 3}
    data = [(f, p, i, "x") for (f, p), n in sizes.items() for i in range(n)] + [("hot", f"{p:03d}", 0, "x") for p in range(300)]
    df = spark.createDataFrame(data, "source_url string, landed_seq string, pos int, title string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for n in (1, 2, 4, 100):
            want = []
            for name in {row[0] for row in data}:
                # Spark's order has nulls first
                mine = sorted((r for r in data if r[0] == name), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
                want += mine[:n]
            got = ingest.head_over_pages(df, n=n)
            assert got.columns == df.columns
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert ingest.head_over_pages(df.limit(0), n=3).collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_guard_cuts_the_feed_before_it_looks_at_the_age(spark):
    now = datetime(2024, 2, 1)
    items = [("a", 0, now - timedelta(days=1)), ("a", 1, now - timedelta(days=30)), ("a", 2, None), ("a", 3, now)]
    df = spark.createDataFrame(items, "source_url string, pos int, published_at timestamp")
    assert rows(ingest.age_guard(df, now), "pos") == [(0,), (2,), (3,)]
    assert rows(ingest.age_guard(ingest.head_of_feed(df, n=2), now), "pos") == [(0,)]
    assert rows(ingest.age_guard(df, now - timedelta(days=-7)), "pos") == [(2,), (3,)]


def test_merge_keeps_first_address_and_last_text_in_any_row_order(spark):
    versions = [("s", "g", 2, "u2", "t2"), ("s", "g", 1, "u1", "t1"), ("s", "h", 1, "u3", None), ("s", "g", 3, "u3", "t3")]
    for _ in range(2):
        versions.reverse()
        df = spark.createDataFrame(versions, "s string, e string, seq int, url string, title string")
        got = upsert.merge_first_last(df, ["s", "e"], ["seq"], ["url"], ["title"])
        assert rows(got, "e", "url", "title", "n_versions") == [("g", "u1", "t3", 3), ("h", "u3", None, 1)]


def test_insert_if_absent_takes_the_first_new_row_per_key(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, url string")
    existing = spark.createDataFrame([("a",), ("z",), ("a",)], "url string")
    got = upsert.insert_if_absent(batch, existing, ["url"], [F.col("id")])
    assert rows(got, "id", "url") == [(2, "b"), (4, "c")]
    assert rows(upsert.unseen(batch, existing, ["url"]), "id") == [(2,), (3,), (4,)]


def test_key_conflicts_go_to_later_identities(spark, salts):
    data = [(f"x{i}", "s", "u" if i < 30 else f"u{i}", i) for i in range(60)]
    df = spark.createDataFrame(data, "id string, source string, url string, pos int")
    got = upsert.flag_key_conflicts(df, ["source", "url"], "id", ["pos"])
    assert rows(got.filter("conflict"), "id") == sorted((f"x{i}",) for i in range(1, 30))


def test_routing_and_sent_checks(spark):
    scores = spark.createDataFrame([(0.75,), (0.749,), (0.5,), (0.3,)], "s double")
    got = [r[0] for r in scores.select(routing.route(F.col("s"), 0.75, 0.5)).collect()]
    assert got == ["push", "digest", "digest", "archive"]
    assert scores.filter(routing.route(F.col("s")) == "archive").isEmpty()
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    events = spark.createDataFrame(
        [("a", "r", "sent"), ("a", "r", "sent"), ("b", "r:digest", "sent"), ("c", "r", "failed")],
        "item_id string, recipient string, status string",
    )
    assert rows(routing.not_yet_sent(items, events), "id") == [("c",)]
    assert rows(routing.not_yet_sent(items, events, "r"), "id") == [("b",), ("c",)]
    assert len(rows(routing.not_yet_sent(items, events, force=True), "id")) == 3


def test_digest_takes_the_newest_with_ties_by_id(spark):
    items = spark.createDataFrame(
        [(i, START + timedelta(minutes=i // 3), "ready" if i % 5 else "ignored") for i in range(60)],
        "id int, created_at timestamp, status string",
    )
    log = [(1, i, START, 0.9) for i in range(60)] + [(2, i, START + timedelta(1), 0.5) for i in range(0, 60, 2)]
    analyses = spark.createDataFrame(log, "id int, item_id int, created_at timestamp, importance_score double")
    events = spark.createDataFrame(
        [(58, "r:digest", "sent"), (56, "r", "sent")], "item_id int, recipient string, status string"
    )
    waiting = digest.digest_candidates(items, analyses, events, "r")
    chosen = digest.number_lines(digest.select_digest(waiting, "bad")).orderBy("idx").collect()
    want = [i for i in range(59, -1, -1) if i % 5 and i % 2 == 0 and i != 58][: digest_limit("bad")]
    assert [r.id for r in chosen] == sorted(want, key=lambda i: (-(i // 3), -i))


def test_schedules():
    assert schedule_hours("17, 9, bad, 99") == [540, 1020] and schedule_hours("bad") == [540, 1020]
    assert schedule_times("17:30, 09:00, bad, 99:00, 9:00") == [540, 1050]
    assert schedule_times("bad", "8, 20") == [480, 1200]


def test_next_slot_rolls_over(spark):
    times = [datetime(2026, 6, 13, 8, 30), datetime(2026, 6, 13, 9, 15), datetime(2026, 6, 13, 17, 30)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r[0] for r in df.select(next_slot(F.col("t"), [555, 1020])).collect()]
    assert got == [datetime(2026, 6, 13, 9, 15), datetime(2026, 6, 13, 17), datetime(2026, 6, 14, 9, 15)]


def test_backoff_and_dead_letters(spark):
    df = spark.range(1, 9).select(retry.backoff_seconds(F.col("id")))
    assert [r[0] for r in df.collect()] == [5, 10, 20, 40, 80, 160, 300, 300]
    log = spark.createDataFrame([("a", START), ("b", START), ("b", START + timedelta(1)), ("c", START)] + [("d", START)] * 3, "k string, t timestamp")
    state = {r.k: (r.attempts, r.status, r.next_retry_at) for r in retry.retry_state(log, "k", "t").collect()}
    assert state["a"] == (1, "pending", START + timedelta(seconds=5))
    assert state["b"] == (2, "pending", START + timedelta(days=1, seconds=10))
    assert state["d"] == (3, "dead", None)


def test_notes_with_equal_titles_get_their_own_paths(spark):
    data = [(i, "Same Title" if i < 20 else f'T "{i}"', "https://x/" + str(i), "S", 'src "q"', START if i % 2 else None) for i in range(24)]
    df = spark.createDataFrame(
        data, "id int, title string, canonical_url string, summary string, source_name string, published_at timestamp"
    )
    built = notes.build_notes(df, datetime(2025, 7, 31, 20), "vault", "Asia/Shanghai").collect()
    paths = {r.item_id: r.path for r in built}
    assert len(set(paths.values())) == 24
    assert paths["21"] == "vault/2024/01/t-21-6f4b6612125f.md"
    assert paths["22"].startswith("vault/2025/08/t-22-")
    assert paths["1"].startswith("vault/2024/01/same-title-")
    text = next(r.markdown for r in built if r.item_id == "21")
    assert text.startswith('---\nsource: "src \\"q\\""\nurl: "https://x/21"\npublished: "2024-01-01"\n')
    assert text.endswith('# T "21"\n\n## Summary\n\nS\n\n## Original\n\nhttps://x/21\n')
