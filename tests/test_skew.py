"""Hot and null keys are spread over the join's partitions."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from feedloom.operators.skew import left_join_unique
from feedloom.operators.upsert import unseen

N = 40_000


@pytest.fixture
def plain_joins(spark):
    """No broadcast by size and no re-planning, so that the plan itself has to spread the rows."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    rows = df.groupBy(F.spark_partition_id()).count().collect()
    return sorted(r["count"] for r in rows)


@pytest.mark.parametrize("hot", ["'hot'", "CAST(NULL AS STRING)"])
@pytest.mark.parametrize("weighed", [False, True])
def test_half_of_the_rows_on_one_key(spark, plain_joins, hot, weighed):
    fact = spark.range(N).select(
        F.col("id"), F.expr(f"IF(id % 2 = 0, {hot}, concat('k', id % 5000))").alias("k")
    )
    dim = fact.filter("k IS NOT NULL").groupBy(F.col("k").alias("d")).agg(F.count("*").alias("n"), F.max("id").alias("m"))
    joined = left_join_unique(fact, dim, "k", "d", "n") if weighed else left_join_unique(fact, dim.drop("n"), "k", "d")
    counts = sizes(joined)
    assert sum(counts) == N
    assert counts[-1] < 2 * median(counts)
    want = fact.join(dim, F.col("k") == F.col("d"), "left").select("id", "k", "m")
    assert joined.exceptAll(want).isEmpty() and want.exceptAll(joined).isEmpty()


def test_unseen_spreads_a_hot_key(spark, plain_joins):
    batch = spark.range(N).select(F.col("id"), F.expr("IF(id % 2 = 0, 'hot', concat('k', id % 5000))").alias("k"))
    existing = spark.createDataFrame([("k1",), ("k3",), ("other",)], "k string")
    rest = unseen(batch, existing, ["k"])
    want = batch.filter(~F.col("k").isin("k1", "k3"))
    assert rest.exceptAll(want).isEmpty() and want.exceptAll(rest).isEmpty()
    counts = sizes(rest)
    assert counts[-1] < 2 * median(counts)
