"""The best rows of each query inside a task, block by block: what leaves a task doesn't grow with its rows.

Where many queries look for the best of many groups, rows are first dealt out by their groups, so that few tasks send rows of a group.
"""

from __future__ import annotations

import ctypes
from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a block, and bytes of a part of it.
ROWS, BYTES, PART = 32_768, 8_000_000, 4_000_000
#: Scores of queries and rows that are held at a time.
PRODUCTS = 1_000_000
#: Scores that a task holds to compare with; beyond, they are dropped, and more rows leave the task.
HELD = 8_000_000
#: Rows of a batch that leaves a task, and rows that are gathered before any leave.
SENT, GATHERED = 50_000, 250_000
#: Rows that a task keeps before it sends on those that are still among the best.
POOL = 500_000
#: Tasks for each core, at most: each sends its own best rows.
TASKS = 4
#: Rows are dealt out by groups if tasks would send on more than so many times as many; rows of a task then.
DEALT, TASK_ROWS = 8, 200_000
#: What a row takes besides, in pairs of a query and a row; places of the rows of a group on the line of all groups.
PLAIN, PLACES = 5000, 1_000_003


def fewer(df: DataFrame) -> DataFrame:
    """The rows in a number of tasks that goes by the cores, so that what all tasks send doesn't grow with the rows."""
    return df.coalesce(TASKS * df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, group: str, key: str, sizes: dict[Hashable, int], asked: dict[Hashable, int], k: int) -> DataFrame:
    """The rows in the tasks that look for the best: where they are read, or dealt out by groups if those tasks would send on too many.

    sizes: the rows of each group; asked: the queries of each, None for those of all groups. Groups lie one after the
    other on a line that is cut into even parts by the work, so a group is in few tasks, and a large one in several.
    """
    tasks = TASKS * df.sparkSession.sparkContext.defaultParallelism
    slots = {g: asked.get(None, 0) + (asked.get(g, 0) if g is not None else 0) for g in sizes}
    total = sum(sizes.values())
    if tasks * sum(slots.values()) * k <= DEALT * total:
        return fewer(df)
    tasks = max(tasks, total // TASK_ROWS)
    work = np.array([n * (PLAIN + slots[g]) for g, n in sizes.items()], float)
    share = work / work.sum()
    spots = df.sparkSession.createDataFrame(list(zip(sizes, (np.cumsum(share) - share).tolist(), share.tolist())), f"_group {dict(df.dtypes)[group]}, _start DOUBLE, _share DOUBLE")
    at = F.col("_start") + F.col("_share") * F.pmod(F.xxhash64(key), F.lit(PLACES)) / PLACES
    part = F.least(F.floor(F.coalesce(at, F.lit(0.0)) * tasks), F.lit(tasks - 1)).cast("int")
    placed = df.join(F.broadcast(spots), F.col(group).eqNullSafe(F.col("_group")), "left").select(*df.columns, part.alias("_part"))
    return placed.repartitionById(tasks, F.col("_part")).drop("_part")


def shares(queries: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The queries in parts of about so many at most, by the hash of their key."""
    parts = -(-queries.count() // most)
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [queries]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Gives freed memory back to the machine: workers outlive their tasks, and what they keep counts for their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(block: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Where each part of a block begins, and the part: what is made of all its tokens at once stays small."""
    step = max(1, block.num_rows * PART // max(PART, block.nbytes))
    for i in range(0, block.num_rows, step):
        yield i, block.slice(i, step)


def order(table: pa.Table, names: list[str]) -> np.ndarray:
    """The rows in the order of the columns, as Spark sorts them."""
    keys = table.select(names)
    return pc.sort_indices(keys, sort_keys=[(n, "ascending") for n in names], null_placement="at_start").to_numpy()


def members(names: pa.ChunkedArray) -> dict[Hashable, np.ndarray]:
    """The places of the rows of each group, ascending."""
    code = names.combine_chunks().dictionary_encode("encode")
    at = code.indices.to_numpy(zero_copy_only=False)
    by = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[by], np.arange(len(code.dictionary) + 1))
    return {g: by[edges[i] : edges[i + 1]] for i, g in enumerate(code.dictionary.to_pylist())}


class Best:
    """Which rows of a block may be among the k best of a slot (a query, or a query in a group), after the blocks before.

    Scores are rounded before they compare. Of equal ones in a block the first stay, so blocks are sorted; those equal to
    the worst of the blocks before are kept too, as their keys decide later. Slots come many at a time, as a family: the
    same queries in one group.
    """

    def __init__(self, k: int, digits: int):
        self.k, self.digits, self.margin = k, digits, 10.0**-digits
        self.held: dict[Hashable, np.ndarray] = {}
        self.cells = 0
        self.out: list[tuple] = []
        self.rows = 0
        #: Where the slots of a family begin.
        self.base: dict[Hashable, int] = {}
        #: Slots, queries, rows and scores that are kept, and the tables that the rows count through.
        self.pool: list[tuple] = []
        self.tables: list[pa.Table] = []
        self.pooled = self.table_rows = 0

    def add(self, family: Hashable, queries: np.ndarray, part: slice, raw: np.ndarray, rows: np.ndarray | slice) -> None:
        """queries: all of the family; part: those at hand. raw: a line of scores for each of them, in the order of the rows; minus infinity for none. rows: their places in the block."""
        k = self.k
        if family not in self.held:
            self.held[family] = np.full((queries.size, k), -np.inf)
            self.base[family] = self.cells // k
            self.cells += queries.size * k
        held = self.held[family][part]
        floor = held[:, 0].copy()
        low = floor.copy()
        if raw.shape[1] > k and (new := np.flatnonzero(floor == -np.inf)).size:
            at = raw.shape[1] - k
            low[new] = np.partition(raw if new.size == floor.size else raw[new], at, axis=1)[:, at]
        mask = raw >= (low - self.margin)[:, None]
        if low.min(initial=0) == -np.inf:
            mask &= raw > -np.inf
        line, at = np.divmod(np.flatnonzero(mask), raw.shape[1])
        s = np.round(raw[line, at], self.digits) + 0.0
        if not (keep := s >= floor[line]).all():
            line, at, s = line[keep], at[keep], s[keep]
        if not s.size:
            return
        by = np.lexsort((-s, line))
        line, at, s = line[by], at[by], s[by]
        count = np.bincount(line, minlength=floor.size)
        place = np.arange(s.size) - (np.cumsum(count) - count)[line]
        if count.max() > k:
            keep = place < k
            line, at, s, place = line[keep], at[keep], s[keep], place[keep]
        hit = np.flatnonzero(count)
        both = np.full((floor.size, k), -np.inf)
        both[line, place] = s
        both = np.concatenate([held[hit], both[hit]], axis=1)
        both.sort(axis=1)
        held[hit] = both[:, -k:]
        self.out.append((queries[part][line], at + (rows.start or 0) if isinstance(rows, slice) else rows[at], s, line + (self.base[family] + (part.start or 0))))
        self.rows += s.size

    def gathered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries, rows and scores since the last call."""
        return self._taken()[:3]

    def _taken(self) -> tuple[np.ndarray, ...]:
        empty = np.zeros(0, np.int64)
        out = [np.concatenate(x) for x in zip(*self.out)] if self.out else [empty, empty, np.zeros(0), empty]
        self.out, self.rows = [], 0
        return tuple(out)

    def full(self) -> bool:
        return self.rows >= GATHERED

    def sent(self, table: pa.Table, ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Keeps what was gathered from the table; if that is much, sends on what is still among the best."""
        query, row, score, slot = self._taken()
        if query.size:
            if not self.tables or self.tables[-1] is not table:
                self.tables.append(table)
                self.table_rows += table.num_rows
            self.pool.append((slot, query, row + (self.table_rows - table.num_rows), score))
            self.pooled += query.size
        pruned = self.pooled > POOL
        if pruned:
            self._prune()
        if self.pooled > POOL // 2 and pruned or self.table_rows > POOL or self.cells > HELD:
            yield from self.rest(ids, schema)

    def _prune(self) -> None:
        """Leaves out what is worse than the k best so far."""
        slot, query, row, score = (np.concatenate(x) for x in zip(*self.pool))
        floor = np.concatenate([x[:, 0] for x in self.held.values()])
        keep = score >= floor[slot]
        self.pool = [(slot[keep], query[keep], row[keep], score[keep])]
        self.pooled = int(keep.sum())

    def rest(self, ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """What is kept, as the query's id, the columns of the tables between, and the score."""
        if self.pooled:
            self._prune()
            names = schema.names[1:-1]
            table = pa.concat_tables([t.select(names) for t in self.tables])
            _, query, row, score = self.pool[0]
            for i in range(0, query.size, SENT):
                part = slice(i, i + SENT)
                picked = table.take(pa.array(row[part]))
                cols = [ids.take(pa.array(query[part])), *(c.combine_chunks() for c in picked.columns), pa.array(score[part])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
        self.pool, self.tables, self.pooled, self.table_rows = [], [], 0, 0
        if self.cells > HELD:
            self.held.clear()
            self.base.clear()
            self.cells = 0
