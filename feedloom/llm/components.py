"""Connected components over an edge table, with the smallest node as the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): ``root`` is the smallest node reachable; only nodes with an edge are listed.

    Alternating large-star and small-star rounds over edges that point from the larger to the
    smaller node. A round is two aggregates with map-side combine and two joins of written tables,
    which AQE may split where one node holds many edges; the number of rounds grows with the
    logarithm of the longest path. Null ends and loops are ignored; an empty table gives no rows.
    """
    links = materialize(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .distinct()
    )
    state = _state(links)
    while True:
        ends = links.select("big", "small").unionByName(
            links.select(F.col("small").alias("big"), F.col("big").alias("small"))
        )
        lowest = materialize(
            ends.groupBy(F.col("big").alias("__node")).agg(F.min("small").alias("__low"))
            .select("__node", F.least("__node", "__low").alias("__low"))
        )
        large = materialize(
            links.join(lowest, F.col("small") == F.col("__node"))
            .select("big", F.col("__low").alias("small"))
            .distinct()
        )
        parents = materialize(
            large.groupBy(F.col("big").alias("__node")).agg(F.min("small").alias("__low"))
        )
        moved = large.join(parents, F.col("big") == F.col("__node")).filter(F.col("small") != F.col("__low"))
        links = materialize(
            moved.select(F.col("small").alias("big"), F.col("__low").alias("small"))
            .unionByName(parents.select(F.col("__node").alias("big"), F.col("__low").alias("small")))
            .distinct()
        )
        after = _state(links)
        if after == state:
            break
        state = after
    nodes = links.select(F.col("big").alias("node"), F.col("small").alias("root"))
    roots = links.select(F.col("small").alias("node")).distinct()
    return nodes.unionByName(roots.select("node", F.col("node").alias("root")))
