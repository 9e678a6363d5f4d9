"""Python functions over single rows, fed by Arrow in small pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

# A piece ends before it holds more rows or, beyond its first row, more bytes of the first column.
PIECE_ROWS = 512
PIECE_BYTES = 1 << 20


def row_udf(
    read: Callable[..., Any], kind: pa.DataType, ddl: str, rows: int = PIECE_ROWS, size: int = PIECE_BYTES
) -> Callable[..., Any]:
    """Arrow UDF of ``read``, a local function from the values of a row to one of ``kind`` (``ddl`` to Spark).

    A batch, which holds up to ``spark.sql.execution.arrow.maxRecordsPerBatch`` documents, is read and
    answered piece by piece, so that a worker holds the Python values of one piece alone. The code
    travels with the query, so workers need no package.
    """

    def pieces(first: pa.Array) -> Iterator[tuple[int, int]]:
        start = held = 0
        for i, n in enumerate(pc.binary_length(first).to_pylist()):
            if i > start and (i - start == rows or held + (n or 0) > size):
                yield start, i - start
                start, held = i, 0
            held += n or 0
        yield start, len(first) - start

    def answer(columns: tuple[pa.Array, ...], start: int, n: int) -> pa.Array:
        values = zip(*(c.slice(start, n).to_pylist() for c in columns), strict=True)
        return pa.array([read(*v) for v in values], kind)

    def over_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, n in pieces(batch):
                yield answer((batch,), start, n)

    def over_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, n in pieces(batch[0]):
                yield answer(batch, start, n)

    return F.arrow_udf(over_one if read.__code__.co_argcount == 1 else over_many, ddl)
