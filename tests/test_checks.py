"""Constraint checks of a batch against the same rules in plain Python."""

import random

import pytest

from feedloom.operators.checks import Constraints, check_batch

DDL = "id int, a string, b int, kind string, ref int, at int"


def by_hand(rows, parents, stored):
    out = {}
    for r in rows:
        broken = ["null:a"] * (r[1] is None) + ["domain:kind"] * (r[3] is not None and r[3] not in "xy")
        broken += ["orphan:ref"] * (r[4] is not None and r[4] not in parents)
        out[r[0]] = ",".join(broken) or None
    seen = {key for key in stored if None not in key}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        if out[r[0]] is None and r[1] is not None and r[2] is not None:
            if (r[1], r[2]) in seen:
                out[r[0]] = "unique:a+b"
            seen.add((r[1], r[2]))
    return out


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rows_are_refused_one_by_one(spark, threshold):
    rng = random.Random(7)
    rows = [
        (i, rng.choice([None, "p", "q", "r"]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "x", "y", "z"]),
         rng.choice([None, 1, 2, 9]), rng.randrange(20))
        for i in range(300)
    ]
    # one key holds a third of the batch
    rows += [(i, "hot", 1, "x", 1, 5) for i in range(300, 450)]
    parents, stored = [1, 2, 2, 3, None], [("p", 1), ("p", 1), ("q", None), ("zz", 5), (None, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        parent = spark.createDataFrame([(p,) for p in parents], "pid int")
        existing = spark.createDataFrame(stored, "a string, b int")
        rules = Constraints(["a"], {"kind": ["x", "y"]}, {"ref": (parent, "pid")}, ["a", "b"], ["at", "id"])
        batch = spark.createDataFrame(rows, DDL)
        out = check_batch(batch, rules, existing)
        assert out.columns == [*batch.columns, "refused"]
        got = {r.id: r.refused for r in out.collect()}
        assert len(got) == len(rows) and got == by_hand(rows, parents, stored)
        # what is accepted breaks nothing together with what is stored
        accepted = [r for r in rows if got[r[0]] is None]
        keys = [(r[1], r[2]) for r in accepted if r[2] is not None]
        assert len(keys) == len(set(keys)) and not set(keys) & set(stored)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_rows_empty_batches_and_no_rules(spark):
    rules = Constraints(unique=["a", "b"], order=["at"])
    twice = spark.createDataFrame([(1, "p", 1, "x", 1, 0)] * 3, DDL)
    assert sorted(str(r.refused) for r in check_batch(twice, rules).collect()) == ["None", "unique:a+b", "unique:a+b"]
    assert check_batch(twice.limit(0), rules, twice).collect() == []
    assert [r.refused for r in check_batch(twice, Constraints()).collect()] == [None] * 3
