"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Vectors of one label whose cosine is at least ``LEAST`` are linked.  On the unit sphere such a pair is
at most d = sqrt(2 - 2 * LEAST) apart, so on a random Gaussian direction its projections differ by
a normal variable of deviation d at most.  Each vector is a query: on each of ``PROJECTIONS`` sorted
directions, the vectors within a window around its own projection collide with it.  The window and the
number of collisions that a candidate must reach are calibrated, from the binomial law, to find a pair
at the limit with probability ``RECALL``; candidates are verified by their cosine in double precision.

A window of fixed width holds a fixed share of a label, so windows over whole labels would meet a
share of all pairs.  Vectors are therefore dealt to cells first, by ``folds`` more directions cut at random
offsets, once for each of several ``tables``.  ``plan`` sets both from the largest label's size, so that
some ``CELL`` unrelated vectors share a cell and that a pair at the limit shares a cell in some table with
probability ``RECALL`` too, at every size.  Windows are sorted and counted in each cell; a pair counts in the
first table whose cell it shares.  Labels up to ``CELL`` in size are one cell.

Equal vectors become one node first.  Cells of more than ``BLOCK`` nodes are cut by hash, each two blocks
a group of their own.  A group returns its nodes' numbers of links and a spanning forest of the links, never
the pairs, so a dense group costs no more rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
a null label, link with nothing and are their own component; vectors of different length do not link;
equal vectors of one label link with each other whatever their number; a null id never becomes a
component's id unless all are null; repeated rows count as separate vectors; pairs at the limit itself (a
tie with ``LEAST``) link; the empty table gives no rows; columns besides the id, vector and label columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import components, cut

LEAST, PROJECTIONS, RECALL, BLOCK, CELL, SEED = 0.98, 24, 0.995, 256, 64, 11
#: Width of a window in deviations of the difference at the limit, and of a cell.
WINDOW, WIDTH = 1.5, 1.0
#: Places of pairs counted at a time.
SLOTS = 1 << 21


def distance(least: float) -> float:
    return math.sqrt(2 - 2 * least)


def needed(least: float = LEAST, m: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The largest number of collisions that a pair at the limit reaches with probability ``recall``."""
    p = math.erf(WINDOW / math.sqrt(2))
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def shared(apart: float, width: float = WIDTH) -> float:
    """The chance that the projections of two points so far apart fall in one cell."""
    r = width / apart
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(folds, tables) for labels of up to ``n`` vectors."""
    near, far = shared(distance(least)), shared(math.sqrt(2))
    folds = max(0, math.ceil(math.log(max(n, 1) / CELL) / -math.log(far)))
    return folds, 1 if folds == 0 else math.ceil(math.log(1 - recall) / math.log(1 - near**folds))


def directions(dim: int, m: int, use: int = 0) -> np.ndarray:
    return np.random.default_rng([SEED, dim, use]).standard_normal((dim, m))


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cells(vectors: np.ndarray, folds: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table."""
    if folds == 0:
        return np.zeros((len(vectors), tables), np.int64)
    way = directions(vectors.shape[1], folds * tables, 1)
    offset = np.random.default_rng([SEED, 2]).random(folds * tables)
    at = np.floor(vectors @ way / WIDTH + offset).astype(np.int64).reshape(len(vectors), tables, folds)
    odd = np.random.default_rng([SEED, 3]).integers(0, 1 << 62, folds) * 2 + 1
    return (at * odd).sum(axis=2)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs (node, smallest node of its component), of the links a-b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        np.minimum.at(low, before, low)  # what a node has reached, its old root has reached
        low = low[low]
        if (low == before).all():
            break
    own = np.flatnonzero(low != np.arange(n))
    return own, low[own]


def _met(u: np.ndarray, group: np.ndarray, least: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, of rows of one group that collide often enough; groups are numbered in order."""
    size = np.bincount(group)
    base = np.cumsum(size * size) - size * size
    first = np.cumsum(size) - size
    own = np.arange(len(u)) - first[group]
    hits = np.zeros(int((size * size).sum()), np.uint8)
    window = WINDOW * distance(least)
    projected = u @ directions(u.shape[1], m)
    for p in projected.T:
        # sorted within its group, each row meets those in the window below it
        key = group * (4 * np.abs(projected).max() + 4 * window) + p
        order = np.argsort(key)
        key = key[order]
        low = np.searchsorted(key, key - window)
        held = np.arange(len(key)) - low
        upper = np.repeat(np.arange(len(key)), held)
        lower = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held - low, held)
        i, j = order[upper], order[lower]
        slot = base[group[i]] + np.minimum(own[i], own[j]) * size[group[i]] + np.maximum(own[i], own[j])
        hits[slot] += 1  # a pair meets once in a projection
    slot = np.flatnonzero(hits >= needed(least, m))
    which = np.searchsorted(base, slot, "right") - 1
    at = slot - base[which]
    return first[which] + at // size[which], first[which] + at % size[which]


def _linked(u: np.ndarray, group: np.ndarray, least: float = LEAST, m: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among the unit vectors of each group."""
    a, b = _met(u, group, least, m)
    found = [np.flatnonzero(np.einsum("ij,ij->i", u[a[at : at + (1 << 16)]], u[b[at : at + (1 << 16)]]) >= least) + at for at in range(0, len(a), 1 << 16)]
    ok = np.concatenate([np.zeros(0, np.int64), *found])
    return a[ok], b[ok]


def compare(left: np.ndarray, right: np.ndarray | None, least: float = LEAST, m: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of the vectors ``left`` with ``right``, or i < j among ``left`` if that is None."""
    every = left if right is None else np.concatenate((left, right))
    a, b = _linked(units(every), np.zeros(len(every), np.int64), least, m)
    if right is None:
        return a, b
    across = (a < len(left)) & (b >= len(left))
    return a[across], b[across] - len(left)


_ROW = ["node", "times", "vector", "cells", "t", "side", "cross", "dim", "key"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by dimension, then group; as many whole groups go together as SLOTS allows."""
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= 1 << 14:
            yield from _compared(held, False)
            held = [x for x in held if x.num_rows]
            count = sum(x.num_rows for x in held)
    if held:
        yield from _compared(held, True)


def _compared(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Partial link counts (other = -1) and forest edges (n = 0) of the whole groups; ``held`` keeps the rest."""
    rows = pa.Table.from_batches(held)
    key, dim = rows["key"].to_numpy(), rows["dim"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (dim[1:] != dim[:-1]))))
    ends = np.append(first[1:], len(key))
    whole = len(first) if last else len(first) - 1
    at = 0
    while at < whole:
        size = ends[at:whole] - first[at:whole]
        same = int(np.argmax(np.append(dim[first[at:whole]] != dim[first[at]], True)))
        upto = at + max(1, min(same, int(np.searchsorted(np.cumsum(size * size), SLOTS, "right"))))
        yield _counted(rows.slice(first[at], ends[upto - 1] - first[at]), np.repeat(np.arange(upto - at), size[: upto - at]))
        at = upto
    held[:] = [] if whole == len(first) else rows.slice(first[whole]).combine_chunks().to_batches()


def _counted(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    node, times, t, side, cross = (rows[c].to_numpy() for c in ("node", "times", "t", "side", "cross"))
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    vectors, own = flat("vector").astype(np.float64), flat("cells")
    a, b = _linked(units(vectors), group)
    # pairs of two blocks only, and of no earlier table
    ok = (cross[a] == 0) | (side[a] != side[b])
    ok &= ~((own[a] == own[b]) & (np.arange(own.shape[1]) < t[a][:, None])).any(axis=1)
    a, b = a[ok], b[ok]
    linked = np.bincount(a, times[b], len(rows)) + np.bincount(b, times[a], len(rows))
    has = np.flatnonzero(linked)
    child, root = _forest(len(rows), a, b)
    cols = (np.concatenate((node[has], node[child])), np.concatenate((np.full(len(has), -1), node[root])), np.concatenate((linked[has].astype(np.int64), np.zeros(len(child), np.int64))))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "other", "n"])


def _dealing(folds: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            flat, ends = lists.flatten().to_numpy().astype(np.float64), np.cumsum(sizes)
            out = np.zeros((len(sizes), tables), np.int64)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                out[own] = cells(units(flat[(ends - sizes)[own][:, None] + np.arange(dim)]), folds, tables)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), made], names=[*b.schema.names, "dim", "cells"])

    return run


def dealt(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``nodes`` (node, times, label, vector, dim, cells) for each group that they take part in."""
    name = F.xxhash64("label", "dim", "t", F.get("cells", F.col("t")))
    placed = nodes.select("*", F.explode(F.sequence(F.lit(0), F.size("cells") - 1)).alias("t")).withColumn("cell", name)
    large = placed.groupBy("cell").agg(F.count("*").alias("held")).where(F.col("held") > block)
    placed = placed.join(large, "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("held") / block), F.lit(1)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return placed.select(
        "node", "times", "vector", "cells", "t", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).cast("int").alias("cross"), "dim",
        F.xxhash64("cell", i, j).alias("key"),
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component) for each row."""
    x = F.col("vector")
    sound = x.isNotNull() & F.col("label").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = rows.where("sound").groupBy("label", "vector").agg(F.count("*").alias("times"), F.min("id").alias("least"))
    # numbered once, in the shared folder, so that the numbers stay
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    kind = dict(nodes.dtypes)["vector"]
    celled = nodes.select("node", "times", "label", "vector").mapInArrow(_dealing(*plan(most)), f"node long, times long, label string, vector {kind}, dim int, cells array<long>")
    ready = dealt(cut(celled), block).repartition("key").sortWithinPartitions("dim", "key")
    found = cut(ready.mapInArrow(_groups, "node long, other long, n long"))
    linked = found.where("other = -1").groupBy("node").agg(F.sum("n").alias("linked"))
    roots = components(found.where("other >= 0").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = nodes.select("node", "label", "vector", "times", "least").join(linked, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root")
    named = cut(named.select("label", "vector", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component"))
    lone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return rows.where("sound").join(named, ["label", "vector"]).select("id", "n_links", "component").unionByName(lone)


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``vectors``."""
    found = near_duplicates(vectors)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
