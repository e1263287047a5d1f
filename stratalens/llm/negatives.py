"""Hard-negative mining by blocked dense products over a grid of anchor blocks and candidate blocks.

1. Rows.  Those that take part are kept in the shared folder with a number of their own, so that rows
   with equal ids stay apart.  A component becomes floor(256 x); products of such vectors are whole numbers, which
   float64 holds exactly as long as no sum can pass 2^53.  A block for which it could is multiplied in Python's
   integers.
2. Positives.  Every anchor block meets every candidate block in a cell of the grid (``operators.grid``): anchor
   blocks are sent to all candidate blocks by the shuffle, as their number grows with the table.  A
   cell multiplies the anchors of each label with its candidates of that label and keeps each anchor's five
   highest; the five highest of all cells are the anchor's positives, since of every part of the
   candidates the part's five highest are enough.
3. Negatives.  Anchors with their positives' scores meet all candidate blocks again.  A cell keeps, for each
   positive, the ``limit`` highest scores of other labels in its window; they are merged alike.

Windows are whole numbers: for a positive at p the least score is p - floor(p / 5), the ceiling of 0.8 p.  A
positive below 0 has an empty window, one at 0 takes scores of 0 only.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a null id is
never an anchor, comes last in ties, and its label is not moved; rows with equal ids are separate rows, each an anchor of its own,
and each other's positives or negatives; vectors of different lengths have no product and don't meet, the empty vector's product
with another is 0; scores beyond the range of a long are taken as its ends; an anchor without positives, and a positive
whose window is empty, has no rows; the empty table has none; other columns are ignored.  No label is one task's alone: blocks are dealt by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import stored
from stratalens.operators import grid

# The contract's scale, its numbers of positives and negatives, and which ids are anchors or change label.
SCALE, POSITIVES, NEGATIVES, ANCHOR, MOVED, LABELS = 256, 5, 5, 100, 7, 10
#: Bytes of a block's vectors, on average.
BLOCK_BYTES = 16 << 20
#: Sums of float64 are exact below it.
EXACT = 2.0**53
LONGEST = 2**63 - 1


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, with the labels moved."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & v.isNotNull() & sound).select("vec_id", moved.cast("long").alias("label"), "embedding")


def whole(matrix: np.ndarray) -> np.ndarray:
    """The components as whole numbers, in float64."""
    return np.floor(np.clip(matrix.astype(np.float64) * SCALE, -1e300, 1e300))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers: as float64 where that is exact, else as int64."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return a @ b.T
    ints = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.array([[min(max(int(x), -LONGEST), LONGEST) for x in row] for row in ints[0] @ ints[1].T], dtype=np.int64).reshape(len(a), len(b))


class Block:
    """Columns of a cell's block as arrays, its vectors by length."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows["vec_id"].combine_chunks()
        self.ids, self.null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.uid, self.label = rows["uid"].to_numpy(), rows["label"].to_numpy()
        self.vectors = {n: (at, whole(m)) for n, (at, m) in grid.by_length(rows["embedding"]).items()}


def _gathered(parts: list[tuple], kinds: list) -> list[np.ndarray]:
    return [np.concatenate([np.asarray(p[i]) for p in parts]).astype(k) if parts else np.empty(0, k) for i, k in enumerate(kinds)]


def _with_ids(columns: dict[str, np.ndarray], ids: np.ndarray, null: np.ndarray, name: str) -> pa.Table:
    return pa.table({**columns, name: pa.array(ids, pa.int64(), mask=null)})


def best_positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """(uid, positive_id, score) of a cell: the first POSITIVES other rows of each anchor's label."""
    parts = []
    if anchors.num_rows and rows.num_rows:
        a, b = Block(anchors), Block(rows)
        for n in set(a.vectors) & set(b.vectors):
            for label in np.intersect1d(a.label, b.label):
                (ai, av), (bi, bv) = ((at[own], m[own]) for at, m, own in ((*x.vectors[n], x.label[x.vectors[n][0]] == label) for x in (a, b)))
                for i, j in grid.tiles(len(ai), len(bi)):
                    scores = products(av[i], bv[j])
                    at, to = grid.leading(scores, a.uid[ai[i]][:, None] != b.uid[bi[j]], POSITIVES)
                    parts.append((ai[i][at], bi[j][to], scores[at, to]))
        at, to, scores = _gathered(parts, [np.int64, np.int64, np.int64])
        kept = grid.first_of([at], [-scores, b.null[to], b.ids[to]], POSITIVES)
        at, to = at[kept], to[kept]
        return _with_ids({"uid": a.uid[at], "score": scores[kept]}, b.ids[to], b.null[to], "positive_id").select(["uid", "positive_id", "score"])
    return pa.table({"uid": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def best_negatives(limit: int):
    """The kernel of a cell: (uid, nth, negative_id, score), the first ``limit`` rows in the window of each anchor's nth positive."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if anchors.num_rows and rows.num_rows:
            a, b = Block(anchors), Block(rows)
            # positives' scores by place; -1 stands for none, and has an empty window like all below 0
            high = np.full((len(a.uid), POSITIVES), -1, np.int64)
            for k, own in enumerate(anchors["scores"].to_pylist()):
                high[k, : len(own)] = own
            low = np.where(high >= 0, high - high // 5, LONGEST)
            least, most = low.min(axis=1), high.max(axis=1)
            for n in set(a.vectors) & set(b.vectors):
                (ai, av), (bi, bv) = a.vectors[n], b.vectors[n]
                for i, j in grid.tiles(len(ai), len(bi)):
                    scores, own = products(av[i], bv[j]), ai[i]
                    at, to = np.nonzero((scores >= least[own][:, None]) & (scores <= most[own][:, None]) & (a.label[own][:, None] != b.label[bi[j]]))
                    score, at, to = scores[at, to].astype(np.int64), own[at], bi[j][to]
                    for nth in range(POSITIVES):
                        fits = np.flatnonzero((score >= low[at, nth]) & (score <= high[at, nth]))
                        kept = fits[grid.first_of([at[fits]], [-score[fits], b.null[to[fits]], b.ids[to[fits]]], limit)]
                        parts.append((at[kept], np.full(len(kept), nth), to[kept], score[kept]))
            at, nth, to, score = _gathered(parts, [np.int64] * 4)
            kept = grid.first_of([at, nth], [-score, b.null[to], b.ids[to]], limit)
            at, to = at[kept], to[kept]
            return _with_ids({"uid": a.uid[at], "nth": nth[kept].astype(np.int32), "score": score[kept]}, b.ids[to], b.null[to], "negative_id").select(["uid", "nth", "negative_id", "score"])
        return pa.table({"uid": pa.array([], pa.int64()), "nth": pa.array([], pa.int32()), "negative_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return run


def mined(embeddings: DataFrame, limit: int = NEGATIVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) for all rows whose id is divisible by ANCHOR."""
    rows = stored(taking_part(embeddings).withColumn("uid", F.monotonically_increasing_id()))
    is_anchor = F.col("vec_id") % ANCHOR == 0
    count, asked, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    shape = grid.shape(rows.sparkSession, asked, count, width * 8, block_bytes)
    anchors = rows.where(is_anchor)
    uid = F.col("uid")

    found = grid.met(anchors, rows, uid, uid, *shape, best_positives, "uid long, positive_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("positive_id").asc_nulls_last())
    positives = found.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < POSITIVES)
    listed = F.sort_array(F.collect_list(F.struct("nth", "positive_id", "score")))  # of POSITIVES at most
    positives = stored(positives.groupBy("uid").agg(listed.alias("positives")))

    paired = anchors.join(positives, "uid").withColumn("scores", F.col("positives.score")).drop("positives")
    found = grid.met(paired, rows, uid, uid, *shape, best_negatives(limit), "uid long, nth int, negative_id long, score long")
    order = Window.partitionBy("uid", "nth").orderBy(F.desc("score"), F.col("negative_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    positive = F.get("positives", F.col("nth"))
    return found.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")).join(positives, "uid"), "uid").select(
        "anchor_id", positive["positive_id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
        (F.col("nth") + 1).alias("positive_rank"),
    )


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns and the positive's rank, by which positives with equal ids can be told apart."""
    return mined(embeddings)
