"""Arrow plumbing shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes, handed to Python code at a time; long texts then never pile up in one batch. One row may be larger.
SLICE_ROWS, SLICE_BYTES = 1000, 16 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and SLICE_BYTES bytes."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > SLICE_BYTES:
            n = (n + 1) // 2
        yield batch.slice(at, n)
        at += n


def map_rows(df: DataFrame, columns: Sequence[str], make: Callable[[], Callable[[list[list]], list[list]]], schema: T.StructType) -> DataFrame:
    """Run a Python function over slices of the named columns, in Arrow batches.

    make: called once in each task; gives the function from column lists to output column lists.
    Only the named columns leave the JVM, under neutral names, so extra or clashing columns of df don't matter.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch):
                out = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    picked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return picked.mapInArrow(run, schema)


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
