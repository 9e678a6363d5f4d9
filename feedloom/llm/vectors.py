"""Near-duplicate embeddings: inverted lists, product-quantised residuals, exact cosine at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.session import materialize

# Distinct vectors that the quantisers are fitted on, at most; every vector is indexed.
SAMPLE_ROWS = 20_000
MOST_CELLS, PARTS, CODES, ROUNDS = 1024, 8, 64, 8
# Vectors of one cell that meet those of one block of queries in a task.
BLOCK_ROWS = 2048
QUERY_CHUNK = 256
SLACK = 1e-9


def unit_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, size, unit): the bytes of the unit vector in double precision, null if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, sizes = [], []
            for vector in batch.column(2).to_pylist():
                unit = None
                if vector and None not in vector:
                    values = np.array(vector, np.float64)
                    most = np.abs(values).max()
                    if 0 < most < np.inf:  # false for NaN
                        values = values / most
                        unit = (values / math.sqrt(float(values @ values)) + 0.0).tobytes()
                units.append(unit)
                sizes.append(len(vector) if unit else None)
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "size", "unit"])

    narrow = rows.select(
        F.col(vec_id).cast("long"), F.col(label).cast("string"), F.col(embedding).cast("array<double>")
    )
    return narrow.mapInArrow(run, "vec_id long, label string, size int, unit binary")


def kmeans(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(ROUNDS):
        near = nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centers."""
    out = (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)
    return np.maximum(out, 0)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return squares(points, centers).argmin(1)


@dataclass
class Quantiser:
    """Cells, and per part of the vector the codes of what is left after the cell's center."""

    cells: np.ndarray
    edges: list[int]
    codes: list[np.ndarray]

    @classmethod
    def fit(cls, points: np.ndarray, n_cells: int) -> Quantiser:
        cells = kmeans(points, n_cells, 0)
        rest = points - cells[nearest(points, cells)]
        edges = np.linspace(0, points.shape[1], min(PARTS, points.shape[1]) + 1).astype(int).tolist()
        codes = [kmeans(rest[:, i:j], CODES, 1 + i) for i, j in zip(edges, edges[1:], strict=False)]
        return cls(cells, edges, codes)

    def parts(self, points: np.ndarray) -> list[np.ndarray]:
        return [points[:, i:j] for i, j in zip(self.edges, self.edges[1:], strict=False)]

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code, and how far the coded vector is from the true one."""
        cell = nearest(points, self.cells)
        rest = points - self.cells[cell]
        code = np.stack([nearest(p, c) for p, c in zip(self.parts(rest), self.codes, strict=True)], 1)
        shown = np.concatenate([c[code[:, m]] for m, c in enumerate(self.codes)], 1)
        return cell, code.astype(np.uint8), np.sqrt(((rest - shown) ** 2).sum(1))

    def probes(self, points: np.ndarray, cell: np.ndarray, reach: float) -> np.ndarray:
        """Every cell that can hold a vector within ``reach``, as a table of points by cells.

        A vector in another cell is on the far side of the plane half-way between the two centers, so
        the cells whose planes are farther than ``reach`` hold none.
        """
        far = squares(points, self.cells)
        own = np.take_along_axis(far, cell[:, None], 1)
        apart = np.sqrt(squares(self.cells, self.cells))[cell]
        return far - own <= 2 * reach * apart + SLACK

    def lookups(self, points: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of exact queries to coded vectors of a cell, by table look-ups."""
        total = np.zeros((len(points), len(code)))
        for m, (p, c) in enumerate(zip(self.parts(points - self.cells[cell]), self.codes, strict=True)):
            total += squares(p, c)[:, code[:, m]]
        return total


def as_matrix(units: pd.Series | list, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, size)


def fitted(classes: DataFrame) -> dict[int, Quantiser]:
    """A quantiser per vector length, fitted on a hash sample of at most about ``SAMPLE_ROWS`` vectors."""
    counts = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    out = {}
    for size, n in counts.items():
        share = min(1.0, SAMPLE_ROWS / n)
        place = F.conv(F.substring("node", 1, 8), 16, 10).cast("double") / 2.0**32
        units = classes.filter((F.col("size") == size) & (place < share)).select("node", "unit").toPandas()
        if units.empty:
            units = classes.filter(F.col("size") == size).select("node", "unit").limit(1).toPandas()
        points = as_matrix(units.sort_values("node")["unit"], size)
        out[size] = Quantiser.fit(points, min(MOST_CELLS, max(1, round(math.sqrt(n)))))
    return out


def index_rows(models: dict[int, Quantiser], reach: float):
    """Per vector: one row for its list (role 0), and one for each cell it has to look into (role 1)."""
    names = ["node", "label", "size", "n", "unit", "role", "cell", "code", "off"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                model = models[int(size)]
                for at in range(0, own.num_rows, 4096):
                    part = own.slice(at, 4096)
                    points = as_matrix(part.column(4).to_pylist(), int(size))
                    cell, code, off = model.encode(points)
                    asks, cells = np.nonzero(model.probes(points, cell, reach))
                    rows = np.concatenate([np.arange(len(points)), asks])
                    taken = part.take(pa.array(rows))
                    nothing = pa.nulls(len(asks), pa.binary())
                    arrays = [
                        *taken.columns[:5],
                        pa.array(np.repeat([0, 1], [len(points), len(asks)]).astype(np.int32)),
                        pa.array(np.concatenate([cell, cells]).astype(np.int32)),
                        pa.concat_arrays([pa.array([c.tobytes() for c in code], pa.binary()), nothing]),
                        pa.array(np.concatenate([off, np.zeros(len(asks))])),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def compare(models: dict[int, Quantiser], least: float, reach: float):
    """Links between one block of queries and one block of a list: counts, and edges that join the same."""
    kinds = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        size, cell = table.column("size")[0].as_py(), table.column("cell")[0].as_py()
        roles = np.asarray(table.column("role"))
        base, asks = table.filter(pa.array(roles == 0)), table.filter(pa.array(roles == 1))
        if not base.num_rows or not asks.num_rows:
            return kinds.empty_table()
        listed, asked = (as_matrix(t.column("unit").to_pylist(), size) for t in (base, asks))
        code = np.frombuffer(b"".join(base.column("code").to_pylist()), np.uint8).reshape(len(listed), -1)
        bound = (reach + np.asarray(base.column("off"))) ** 2 + SLACK
        names, weights = np.array(base.column("node").to_pylist()), np.asarray(base.column("n"))
        queries = np.array(asks.column("node").to_pylist())
        counts = np.zeros(len(asked), np.int64)
        pairs = []
        for at in range(0, len(asked), QUERY_CHUNK):
            part = asked[at : at + QUERY_CHUNK]
            q, b = np.nonzero(models[size].lookups(part, cell, code) <= bound)
            for k in range(0, q.size, 1 << 16):
                qs, bs = q[k : k + (1 << 16)], b[k : k + (1 << 16)]
                linked = np.einsum("ij,ij->i", part[qs], listed[bs]) >= least
                qs, bs = qs[linked] + at, bs[linked]
                other = queries[qs] != names[bs]
                np.add.at(counts, qs[other], weights[bs[other]])
                pairs.append(np.stack([qs[other], bs[other]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        every, place = np.unique(np.concatenate([queries, names]), return_inverse=True)
        x, y = place[pairs[:, 0]], place[len(queries) + pairs[:, 1]]
        label = np.arange(every.size)
        while True:  # the smallest number spreads along the links
            low = np.minimum(label[x], label[y])
            after = label.copy()
            np.minimum.at(after, x, low)
            np.minimum.at(after, y, low)
            after = after[after]
            if (after == label).all():
                break
            label = after
        moved = np.flatnonzero(label != np.arange(every.size))
        has = np.flatnonzero(counts)
        arrays = [
            pa.array(np.concatenate([every[moved], queries[has]]).tolist(), pa.string()),
            pa.array(every[label[moved]].tolist() + [None] * has.size, pa.string()),
            pa.array(np.concatenate([np.zeros(moved.size, np.int64), counts[has]])),
        ]
        return pa.Table.from_arrays(arrays, schema=kinds)

    return run


def links(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, n): with b, an edge of the link graph's forest; without, some of a's links to other vectors."""
    models = fitted(classes)
    reach = math.sqrt(2 - 2 * least)  # distance of unit vectors at that cosine
    rows = materialize(
        classes.select("node", "label", "size", "n", "unit").mapInArrow(
            index_rows(models, reach),
            "node string, label string, size int, n long, unit binary, role int, cell int, code binary, off double",
        )
    )
    place = ["label", "size", "cell"]
    sizes = rows.groupBy(*place).agg(
        F.ceil(F.count_if(F.col("role") == 0) / BLOCK_ROWS).alias("n_lists"),
        F.ceil(F.count_if(F.col("role") == 1) / BLOCK_ROWS).alias("n_asks"),
    )
    sizes = sizes.filter("n_lists > 0 AND n_asks > 0")
    sizes = materialize(sizes.select(*[F.col(c).alias(f"__{c}") for c in place], "n_lists", "n_asks"))
    same = [F.col(c) == F.col(f"__{c}") for c in place]
    blocks = rows.join(sizes, same[0] & same[1] & same[2]).drop(*[f"__{c}" for c in place])
    is_list = F.col("role") == 0

    def side(own: bool, n: str):
        mine = F.pmod(F.xxhash64("node"), F.col(n))
        return F.when(is_list == F.lit(own), F.array(mine)).otherwise(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    # each block of a list meets each block of its queries
    met = blocks.withColumn("list_block", F.explode(side(True, "n_lists")))
    met = met.withColumn("ask_block", F.explode(side(False, "n_asks"))).drop("n_lists", "n_asks")
    groups = met.groupBy(*place, "list_block", "ask_block")
    return groups.applyInArrow(compare(models, least, reach), "a string, b string, n long")


def near_vectors(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = 0.98,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors with the same label that is not null, and the same length, link at a cosine of ``least``
    or more. Equal vectors meet in one class first. Each class is in one inverted list; it asks every
    list that can hold a vector near enough, table look-ups over the residual codes leave out what
    the codes prove to be too far, and the rest is compared exactly, so no link is missed.

    Large lists are cut into blocks by hash; a block returns counts and a spanning forest, not its
    pairs. ``n_links`` counts rows. Null, empty, zero and non-finite vectors, and those with a null
    component, label or id, link with nothing and are components of their own. Rows with the same id
    are compared like any others. An empty table gives an empty result.
    """
    units = materialize(
        unit_vectors(rows, vec_id, embedding, label).withColumn(
            "node",
            F.when(
                F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("unit").isNotNull(),
                F.md5(F.concat(F.encode(F.col("label"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), F.col("unit"))),
            ),
        )
    )
    alone = units.filter(F.col("node").isNull())
    classes = units.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.first("unit").alias("unit"),
        F.count("*").alias("n"), F.min("vec_id").alias("first_id"),
    )
    classes = materialize(classes)
    found = materialize(links(classes, least))
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("__a")).agg(F.sum("n").alias("n_other"))
    roots = materialize(components(found.filter(F.col("b").isNotNull()), "a", "b")).withColumnRenamed("node", "__node")
    joined = materialize(
        classes.select("node", "n", "first_id")
        .join(counts, F.col("node") == F.col("__a"), "left")
        .join(roots, F.col("node") == F.col("__node"), "left")
        .select(
            "node", "first_id", F.coalesce("root", "node").alias("root"),
            (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"),
        )
    )
    lowest = materialize(joined.groupBy(F.col("root").alias("__root")).agg(F.min("first_id").alias("component_id")))
    named = materialize(
        joined.join(lowest, F.col("root") == F.col("__root")).select(
            F.col("node").alias("__node"), "n_links", "component_id"
        )
    )
    linked = units.filter(F.col("node").isNotNull()).join(named, F.col("node") == F.col("__node"))
    both = linked.select("vec_id", "n_links", "component_id").unionByName(
        alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
