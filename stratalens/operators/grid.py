"""Blocks of one table against blocks of another: a grid of cells of bounded size, for joins by score.

Every row of the left table must meet every row of the right one, but no pair of rows is ever a row.
Left rows are dealt to the grid's rows and copied to all columns, right rows to its columns and
copied to all rows, so a cell holds one block of each.  The cells are a cogrouped exchange: nothing goes through
the driver, the plan does not grow with either table, and a lost cell is made again from the shuffle.
The grid moves left x columns + right x rows, which is least when blocks are as large as a task's memory allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of vectors of a block, on average; a task holds a block of each side.
BLOCK_BYTES = 16 << 20
#: Rows of a block, at least, where a table has few blocks.
SMALL = 4096
#: Scores that a task computes at a time.
AREA = 1 << 20
#: Tasks of a grid, at most; beyond it a task takes several cells, one after another.
TASKS = 20_000


def shape(spark: SparkSession, left: int, right: int, width: int, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Rows and columns of the grid for so many rows of ``width`` bytes on either side.

    Blocks are of ``block_bytes``; a table of few blocks has smaller ones, as many as there are shuffle partitions.
    """
    blocks = lambda rows: max(1, -(-rows * max(width, 1) // block_bytes))
    return blocks(left), max(blocks(right), min(int(spark.conf.get("spark.sql.shuffle.partitions")), right // SMALL))


def met(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, rows: int | str, columns: int | str, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    on: tuple[str, ...] = (), cells: int | None = None,
) -> DataFrame:
    """``kernel(left block, right block)`` of each cell of a grid of ``rows`` by ``columns``.

    Keys deal rows to blocks by hash and should be unique; equal keys share a block.  With ``on``, rows meet only
    those with equal values there, in a grid of their own, whose size is in columns named by ``rows`` and ``columns`` on
    both sides; ``cells`` is then the number of all cells.
    """
    size = lambda n: F.col(n) if isinstance(n, str) else F.lit(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), size(n).cast("int") - 1))
    block = lambda key, n: F.pmod(F.xxhash64(key), size(n)).cast("int")
    tasks = min(cells or rows * columns, TASKS)
    keys = [*on, "_row", "_column"]

    def dealt(df: DataFrame, row: Column, column: Column) -> DataFrame:
        named = df.withColumn("_row", row).withColumn("_column", column).repartition(tasks, *keys)
        return named.select(*[F.col(f"`{c}`").alias(c) for c in named.columns])  # both sides may come from one table

    a = dealt(left, block(left_key, rows), every(columns))
    b = dealt(right, every(rows), block(right_key, columns))

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        return kernel(x, y)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(cell, schema)


def by_length(arrays: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists, the numbers of its rows and their matrix; null lists are left out."""
    flat = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    if not len(flat):
        return {}
    lengths = flat.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)  # a null list has no values
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out = {}
    for n in np.unique(lengths):
        if n >= 0:
            rows = np.flatnonzero(lengths == n)
            out[int(n)] = rows, values if len(rows) == len(lengths) and n else values[starts[rows][:, None] + np.arange(n)]
            if out[int(n)][1].ndim == 1:
                out[int(n)] = rows, values.reshape(len(rows), n)
    return out


def tiles(height: int, width: int, area: int = AREA) -> Iterator[tuple[slice, slice]]:
    """Parts of a matrix of at most ``area`` entries, that cover it: all columns of some rows first."""
    wide = max(1, min(width, area // 64))
    high = max(1, area // wide)
    for i in range(0, height, high):
        for j in range(0, width, wide):
            yield slice(i, min(i + high, height)), slice(j, min(j + wide, width))


def leading(scores: np.ndarray, fits: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``limit`` highest scores of each row of a tile that fit, and all that equal the last of them."""
    if scores.shape[1] > limit:
        low = np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf
        held = np.where(fits, scores, low)
        fits = fits & (scores >= np.partition(held, -limit, axis=1)[:, -limit][:, None])
    return np.nonzero(fits)


def first_of(keys: list[np.ndarray], order: list[np.ndarray], limit: int) -> np.ndarray:
    """Indexes of the first ``limit`` entries of each group of ``keys``, by ``order``; the most significant comes first."""
    at = np.lexsort([*order[::-1], *keys[::-1]])
    if not len(at):
        return at
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[at][1:] != k[at][:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[nth < limit]
