"""Hashed counts over whole corpora: tables of a fixed number of cells, whatever the corpus holds.

Such a table has ROWS rows of cells; each item adds to one cell in each row, and the least of its cells is its count. In
a row of w cells, an item's cell holds more than twice the mean load of others with a chance below one half, so a count
is too high by more than 2 / w of all counts with a chance of at most 1 / 2 ** ROWS, at every size of the corpus.
What a typical cell of a full table holds by chance, its median, is taken off. Counts are 64-bit whole numbers, in
parts of UNIT, so that sums don't depend on the order of tasks; for look-ups they are floats, which can't wrap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices

_MULT = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
ROWS = 2
#: One text counts so many units, shared among its copies; divisible by 1 to 10.
UNIT = 5040


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of sequences one element longer."""
    h = (h ^ more.astype(np.uint64)) * _MULT
    return h ^ (h >> np.uint64(29))


def buckets(h: np.ndarray, bits: int, row: int = 0) -> np.ndarray:
    if row:
        h = (h ^ (h >> np.uint64(32))) * _OTHER
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of the n-gram that ends at each place; the first n - 1 places hold shorter ones."""
    h = np.full(codes.size, seed + 1, np.uint64)
    for back in range(n - 1, -1, -1):
        part = np.zeros(codes.size, np.uint64)
        part[back:] = codes[: codes.size - back]
        h = mix(h, part)
    return h


def add(table: np.ndarray, h: np.ndarray, bits: int, weight: np.ndarray | int = 1) -> None:
    """Count items in a flat table of ROWS << bits cells."""
    for row in range(ROWS):
        np.add.at(table, buckets(h, bits, row) + (row << bits), weight)


def sparse(table: np.ndarray, usual: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the cells of a table other than the usual ones."""
    flat = table.reshape(-1)
    at = np.nonzero(flat != usual)[0]
    return at.astype(np.int32), flat[at], usual


def dense(state: tuple[np.ndarray, np.ndarray, float], shape: tuple[int, ...]) -> np.ndarray:
    out = np.full(int(np.prod(shape)), state[2], np.float32)
    out[state[0]] = state[1]
    return out.reshape(shape)


class Counts:
    """Look-ups in a table that add() filled."""

    def __init__(self, table: np.ndarray, bits: int, unit: int = 1):
        self.bits = bits
        rows = table.reshape(ROWS, 1 << bits)
        floor = np.median(rows, axis=1, keepdims=True)
        self.table = (np.maximum(rows - floor, 0) / unit).astype(np.float32)

    def __getstate__(self):
        # only filled cells travel
        return self.bits, sparse(self.table)

    def __setstate__(self, state):
        self.bits, self.table = state[0], dense(state[1], (ROWS, 1 << state[0]))

    def of(self, h: np.ndarray) -> np.ndarray:
        return np.minimum(self.table[0][buckets(h, self.bits, 0)], self.table[1][buckets(h, self.bits, 1)])


def keys(*columns: str) -> list[Column]:
    """Two hashes of a text (or of one beside others), by which its copies are counted."""
    one = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    return [one, F.xxhash64(one, F.lit(1))]


#: Cells for the counts of copies.
COPY_BITS = 22


class Copies:
    """How often a text occurs, by its two hashes. Once is the usual number, and isn't kept."""

    def __init__(self, table: np.ndarray):
        counts = Counts(table, COPY_BITS).table
        self.cells, self.number = [], []
        for row in counts:
            at = np.nonzero(row > 1)[0]
            self.cells.append(at.astype(np.int32))
            self.number.append(row[at].astype(np.int64))

    def of(self, *hashed: np.ndarray) -> np.ndarray:
        out = np.full(hashed[0].size, np.iinfo(np.int64).max)
        for cells, number, h in zip(self.cells, self.number, hashed):
            cell = (h.view(np.uint64) >> np.uint64(64 - COPY_BITS)).astype(np.int32)
            at = np.minimum(np.searchsorted(cells, cell), max(0, cells.size - 1))
            n = np.where(cells[at] == cell, number[at], 1) if cells.size else np.ones(h.size, np.int64)
            out = np.minimum(out, n)
        return out

    def units(self, *hashed: np.ndarray) -> np.ndarray:
        """The units of each text: UNIT over its number of copies."""
        return np.maximum(1, UNIT // self.of(*hashed))


def copies(df: DataFrame, *hashed: list[Column]) -> Copies:
    """The copies of all texts, by the hashes that keys() gives. Only hashes are exchanged, never the texts."""
    cells = [F.shiftrightunsigned(h, 64 - COPY_BITS) + (row << COPY_BITS) for pair in hashed for row, h in enumerate(pair)]
    rows = df.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(ROWS << COPY_BITS, np.int64)
    table[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return Copies(table)


def hashed_counts(df: DataFrame, columns: tuple[str | Column, ...], count: Callable[[list, np.ndarray], None], shape: tuple[int, ...], rows: int = 1000) -> np.ndarray:
    """A table of counts that count() adds up over all rows.

    count: gets the columns of a batch (lists; numbers as arrays) and the task's table, and adds to the table. Each task
    sends the cells it filled, once; what comes back has at most as many cells as the table, which is the bound of every
    later broadcast.
    """
    size = int(np.prod(shape))

    def run(batches):
        table = np.zeros(shape, np.int64)
        for batch in batches:
            for part in slices(batch, rows):
                count([c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else c.to_pylist() for c in part.columns], table)
        flat = table.reshape(-1)
        filled = np.nonzero(flat)[0]
        for at in range(0, filled.size, 1 << 18):
            part = filled[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(flat[part])], names=["cell", "n"])

    picked = df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = picked.mapInArrow(run, "cell INT, n BIGINT").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(shape)
