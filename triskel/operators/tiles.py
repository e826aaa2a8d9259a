"""All-pairs work over vector tables, tile by tile.

Every row belongs to a tile of bounded size. A task holds one tile and streams a strip of
other tiles past it, multiplying small matrices, and adds up inside: its own rows leave
once a strip, streamed rows once a task. In a symmetric problem a strip of tile i has tiles
from i on only, so no mirrored pair of tiles is shipped or computed (``triangle_tasks``).
Two different tables, one of them small, meet in a cogroup instead. No pair is ever emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

TILE_ROWS = 8192
MIN_TILE_ROWS = 256
CHUNK = 128  # rows of a tile that meet all columns at once
# Products are made block by block, small enough to stay in a core's cache: every further step on
# them is then some times faster, and a task's memory does not hang on the size of a tile.
BLOCK_ROWS, BLOCK_COLUMNS = 240, 1024
MAX_TASKS = 16384
STRIP = 16  # streamed tiles a task


def tiles_for(n: int, parallelism: int, tile_rows: int = TILE_ROWS) -> int:
    """Enough tiles to bound their size, and to keep all cores busy on small input."""
    spread = math.ceil(math.sqrt(parallelism))
    return max(1, math.ceil(n / tile_rows), min(spread, math.ceil(n / MIN_TILE_ROWS)))


def tile_count(df: DataFrame, tiles: int | None = None) -> int:
    return tiles or tiles_for(df.count(), df.sparkSession.sparkContext.defaultParallelism)


def _tile_of(key: str, tiles: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(tiles)).cast("int")


def tile_cogroup(
    queries: DataFrame,
    candidates: DataFrame,
    query_key: str,
    candidate_key: str,
    tiles: tuple[int, int],
    kernel: Callable,
    schema: str,
) -> DataFrame:
    """Runs ``kernel(key, query_table, candidate_table)`` on every tile pair.

    A pair with an empty side contributes nothing and never reaches the kernel.
    """
    nq, nc = tiles
    empty = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema).empty_table()

    def run(key, q, c):
        if not (q.num_rows and c.num_rows):
            return empty
        return kernel(key, q, c.rename_columns([n.removeprefix("_c_") for n in c.column_names]))

    # Both sides often are one table. Fresh names keep the columns of the second side
    # apart, or column pruning would take them for those of the first and drop them.
    candidates = candidates.select(*[F.col(n).alias(f"_c_{n}") for n in candidates.columns])
    q = queries.withColumn("_qt", _tile_of(query_key, nq))
    c = candidates.withColumn("_ct", _tile_of(f"_c_{candidate_key}", nc))
    q = q.withColumn("_ct", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = c.withColumn("_qt", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    # Tiles are small in bytes and heavy in arithmetic: fix the task count, or AQE
    # would merge them into too few tasks.
    tasks = min(nq * nc, MAX_TASKS)
    q = q.repartition(tasks, "_qt", "_ct")
    c = c.repartition(tasks, "_qt", "_ct")
    return (
        q.groupBy("_qt", "_ct").cogroup(c.groupBy("_qt", "_ct")).applyInArrow(run, schema)
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """Parts of sorted batches with one task, side and tile each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(n).to_numpy() for n in ("_task", "_side", "_tile")], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        rest = batch.select([n for n in batch.schema.names if n not in ("_task", "_side", "_tile")])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield *(int(v) for v in marks[lo]), rest.slice(lo, hi - lo)


def complete_rows(batch: pa.RecordBatch, vectors: Sequence[str]) -> pa.RecordBatch:
    """Rows whose vectors are all there, with all components.

    Inside a task, as Spark would push such a condition below the columns it reads and
    compute them twice, once for each component.
    """
    for v in vectors:
        column = batch.column(v)
        if column.null_count or column.flatten().null_count:
            there = [x is not None and None not in x for x in column.to_pylist()]
            batch = batch.filter(pa.array(there, pa.bool_()))
    return batch


def strip_scan(
    held: DataFrame, streamed: DataFrame, kernel: Callable, schema: str, tasks: int, vectors: Sequence[str] = ()
) -> DataFrame:
    """Runs ``kernel(tile, held_table, streamed)`` in every task that holds rows.

    Rows that lack one of ``vectors``, or a component of one, take no part.
    Both tables have the same columns, with ``_task`` below ``tasks`` and ``_tile``. ``streamed`` yields
    (tile, part of its rows) in the order of tiles; the kernel yields Arrow tables and must read all of it.
    """
    names = [n for n in held.columns if n not in ("_task", "_tile")]
    order = ["_task", "_side", "_tile", *names]
    both = held.withColumn("_side", F.lit(0)).select(*order).unionByName(streamed.withColumn("_side", F.lit(1)).select(*order))
    wanted = to_arrow_schema(held.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, task in groupby(_pieces(complete_rows(b, vectors) for b in batches), key=lambda p: p[0]):
            mine, tile, waiting = [], None, None
            for piece in task:
                if piece[1]:
                    waiting = piece
                    break
                tile = piece[2]
                mine.append(piece[3])
            if not mine:
                continue  # groupby drops the rest of the task

            def rest(first=waiting, task=task):
                if first is not None:
                    yield first[2], pa.Table.from_batches([first[3]])
                    for piece in task:
                        yield piece[2], pa.Table.from_batches([piece[3]])

            for table in kernel(tile, pa.Table.from_batches(mine).combine_chunks(), rest()):
                yield from table.cast(wanted).to_batches()

    dealt = both.repartitionById(tasks, F.col("_task")).sortWithinPartitions("_task", "_side", "_tile")
    return dealt.mapInArrow(run, schema)


def triangle_tasks(df: DataFrame, key: str, tiles: int, strip: int = STRIP) -> tuple[DataFrame, DataFrame, int]:
    """The held and the streamed rows of every unordered pair of tiles, and the number of tasks."""
    strips = -(-tiles // max(strip, -(-tiles * tiles // MAX_TASKS)))
    strip = -(-tiles // strips)
    rows = df.withColumn("_tile", _tile_of(key, tiles))
    own = F.col("_tile")
    number = F.floor(own / strip).cast("int")
    held = rows.withColumn("_s", F.explode(F.sequence(number, F.lit(strips - 1))))
    held = held.withColumn("_task", own * strips + F.col("_s")).drop("_s")
    streamed = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), own)))
    streamed = streamed.withColumn("_task", F.col("_i") * strips + number).drop("_i")
    return held, streamed, tiles * strips


def same_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where two keys are, for keys of any type."""
    _, codes = np.unique(np.concatenate([a, b]).astype(str) if a.dtype == object else np.concatenate([a, b]), return_inverse=True)
    return codes[: len(a)], codes[len(a) :]


def rows_of(column: pa.Array) -> np.ndarray:
    """List column as a 2-D array; missing or uneven vectors are an error, since
    flattening would hand their values to other rows."""
    if column.null_count or column.flatten().null_count:
        raise ValueError("a vector, or a component of one, is missing")
    widths = pc.list_value_length(column)
    width = widths[0].as_py() if len(column) else 0
    if len(column) and pc.min(widths).as_py() != pc.max(widths).as_py():
        raise ValueError("vectors differ in width")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """list<double> column as a 2-D array."""
    return rows_of(table.column(column).combine_chunks())


def complete(df: DataFrame, *vectors: str) -> DataFrame:
    """Rows whose vectors are all there, with all components. A missing vector has no
    similarity to anything, so such rows take no part in comparisons."""
    for v in vectors:
        df = df.where(F.coalesce(~F.exists(v, lambda x: x.isNull()), F.lit(False)))
    return df


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def values(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def key_type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def sort_by(table: pa.Table, column: str) -> pa.Table:
    return table.sort_by([(column, "ascending")])


def chunks(n: int, size: int = CHUNK) -> Sequence[slice]:
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def blocks(rows: int, columns: int) -> Iterator[tuple[slice, slice]]:
    """Blocks of a product of ``rows`` by ``columns``."""
    for s in chunks(rows, BLOCK_ROWS):
        for c in chunks(columns, BLOCK_COLUMNS):
            yield s, c


def products(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """``left @ right.T`` block by block, in one buffer that the next block overwrites."""
    buffer = np.empty(min(len(left), BLOCK_ROWS) * min(len(right), BLOCK_COLUMNS), np.result_type(left, right))
    for s, c in blocks(len(left), len(right)):
        shape = s.stop - s.start, c.stop - c.start
        yield s, c, np.matmul(left[s], right[c].T, out=buffer[: shape[0] * shape[1]].reshape(shape))


def single_error(width: int, longest: float = 1.0) -> float:
    """Bound, twice over, of the error of a product in single precision of ``width`` components, of
    vectors whose lengths multiply to ``longest``."""
    return (width + 8) * 2.0**-23 * longest


def row_counts(mask: np.ndarray) -> np.ndarray:
    """How many columns of a block are true in each row, eight bytes at a time."""
    if mask.shape[1] % 8 or mask.shape[1] > 8 * 255:
        return mask.sum(axis=1)
    return mask.view(np.uint64).sum(axis=1)[:, None].view(np.uint8).sum(axis=1, dtype=np.int64)


def column_counts(mask: np.ndarray) -> np.ndarray:
    """How many rows of a block are true in each column."""
    if len(mask) > 255:
        return mask.sum(axis=0)
    return mask.view(np.uint8).sum(axis=0, dtype=np.uint8)
