"""Exact cosine top-k under metadata filters, for one query or many at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators import grid, shared
from stratalens.operators.embedding import Provider, embed_query, unit

FILTERS = ("document_family", "release_label", "source_kind")
#: Queries that may be sent to where the points lie.
BLOCK = 1024
#: Results that a task holds before it merges them, in multiples of what it returns.
AHEAD = 8


def metadata_filter(document_family: str | None = None, release_label: str | None = None, source_kind: str | None = None) -> Column | None:
    """All given equalities on the payload; None if none is given."""
    given = {k: v for k, v in zip(FILTERS, (document_family, release_label, source_kind)) if v is not None}
    tests = [F.col(f"payload.{k}") == v for k, v in given.items()]
    return reduce(lambda a, b: a & b, tests) if tests else None


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, to 12 decimals, so that rounding noise does not order equal scores."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 12)


def search(points: DataFrame, query_vector: list[float], limit: int = 5, **filters: str | None) -> DataFrame:
    """(rank, point_id, score, payload) of the best points; ties go by point id.

    The filter stands below the top-k, so ``limit`` rows survive it; a zero vector has no score.
    """
    if limit <= 0:
        raise ValueError("limit must be greater than 0")
    if not query_vector:
        raise ValueError("query_vector must not be empty")
    given = metadata_filter(**filters)
    rows = points if given is None else points.where(given)
    length = sum(x * x for x in query_vector) ** 0.5
    if not length:
        return rows.select(F.lit(1).alias("rank"), "point_id", F.lit(0.0).alias("score"), "payload").limit(0)
    q = F.array(*[F.lit(float(x) / length) for x in query_vector])
    scored = rows.where("unit_vector IS NOT NULL").select("point_id", cosine(F.col("unit_vector"), q).alias("score"), "payload")
    top = scored.orderBy(F.desc("score"), "point_id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).alias("rank"), "point_id", "score", "payload")


def nearest(limit: int):
    """The kernel of a cell: the ``limit`` best points for each query of a block, as (query_id, point_id, score)."""

    def run(asked: pa.Table, points: pa.Table) -> pa.Table:
        parts = [np.empty((0, 3))]
        tests = []
        for f in FILTERS if asked.num_rows and points.num_rows else ():
            codes = pd.factorize(np.concatenate([asked[f"_{f}"].to_numpy(), points[f].to_numpy()]))[0]  # -1 for null
            if (codes[: asked.num_rows] >= 0).any():
                tests.append((codes[: asked.num_rows], codes[asked.num_rows :]))
        queries, vectors = grid.by_length(asked["_q"]), grid.by_length(points["unit_vector"])
        for n in set(queries) & set(vectors):
            (qi, qv), (pi, pv) = queries[n], vectors[n]
            for i, j in grid.tiles(len(qi), len(pi)):
                scores = np.round(qv[i] @ pv[j].T, 12) + 0.0
                fits = np.ones(scores.shape, bool)
                for want, have in tests:
                    own = want[qi[i]][:, None]
                    fits &= (own < 0) | (own == have[pi[j]])
                at, to = grid.leading(scores, fits, limit)
                parts.append(np.stack([qi[i][at], pi[j][to], scores[at, to]], axis=1))
        at, to, scores = np.concatenate(parts).T
        at, to = at.astype(np.int64), to.astype(np.int64)
        order = pc.rank(points["point_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        best = grid.first_of([at], [-scores, order[to]], limit)
        return pa.table({"query_id": asked["query_id"].take(pa.array(at[best])), "point_id": points["point_id"].take(pa.array(to[best])), "score": scores[best]})

    return run


def _in_place(asked: pa.Table, limit: int):
    """For ``mapInArrow`` over points: the ``limit`` best of a task for each query."""
    best = nearest(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in batches:
            parts.append(best(asked, pa.Table.from_batches([b])))
            if sum(p.num_rows for p in parts) > AHEAD * limit * asked.num_rows:
                parts = [_merged(parts, limit)]
        if parts:
            yield from _merged(parts, limit).to_batches()

    return run


def _merged(parts: list[pa.Table], limit: int) -> pa.Table:
    rows = pa.concat_tables(parts)
    group = pc.rank(rows["query_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    order = pc.rank(rows["point_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    return rows.take(pa.array(grid.first_of([group], [-rows["score"].to_numpy(), order], limit)))


def prepared(queries: DataFrame) -> DataFrame:
    """Queries kept with their unit vectors as _q and all filters; those without a direction are left out."""
    filters = [(F.col(f) if f in queries.columns else F.lit(None).cast("string")).alias(f"_{f}") for f in FILTERS]
    return shared.kept(queries.select("query_id", unit(F.col("query_vector")).alias("_q"), *filters).where("_q IS NOT NULL"))


def narrow(points: DataFrame) -> DataFrame:
    """What a search moves of a point: its id, vector and filter fields."""
    return points.where("unit_vector IS NOT NULL").select("point_id", "unit_vector", *[F.col(f"payload.{f}").cast("string").alias(f) for f in FILTERS])


def ranked(found: DataFrame, points: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of all cells' (query_id, point_id, score), with rank and payload."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return top.join(points.select("point_id", "payload"), "point_id").select("query_id", "rank", "point_id", "score", "payload")


def search_many(points: DataFrame, queries: DataFrame, limit: int = 5, few: bool = False, block_bytes: int = grid.BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, point_id, score, payload): top ``limit`` of each query.

    ``queries`` has query_id, query_vector and may have the three filters; a null filter is no
    condition.  Blocks of queries meet blocks of points in the cells of a grid, on the executors; a cell multiplies them
    and keeps ``limit`` of each query, so no pair of a point and a query is a row, and neither
    the plan nor the driver grows with the queries.  Only ids and scores meet in the merge, and the winners' payloads are
    joined afterwards.  Where all queries filter by a field, points of other values are not moved.
    Vectors of another length have no score.

    With ``few``, up to BLOCK queries (counted first) are sent to where the points lie, and points are not moved at all;
    more go by the grid all the same.
    """
    if limit <= 0:
        raise ValueError("limit must be greater than 0")
    asked, spark = prepared(queries), queries.sparkSession
    count, width, *given = asked.agg(F.count("*"), F.coalesce(F.max(F.size("_q")), F.lit(0)), *[F.count(f"_{f}") for f in FILTERS]).first()
    rows = narrow(points)
    for f, n in zip(FILTERS, given):
        if count and n == count:
            rows = rows.join(asked.select(F.col(f"_{f}").alias(f)).distinct(), f, "left_semi")
    rows = rows.select("point_id", "unit_vector", *FILTERS)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, point_id string, score double"
    if few and count <= BLOCK:
        found = rows.mapInArrow(_in_place(asked.toArrow(), limit), schema)
    else:
        shape = grid.shape(spark, count, points.count(), width * 8, block_bytes)
        found = grid.met(asked, rows, F.col("query_id"), F.col("point_id"), *shape, nearest(limit), schema)
    return ranked(found, points, limit)


def search_texts(points: DataFrame, queries: DataFrame, provider: Provider, limit: int = 5, few: bool = False) -> DataFrame:
    """``search_many`` for queries given as text in column ``query``."""
    return search_many(points, embed_query(queries, provider), limit, few)


def preview(text: Column, n: int = 300) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))
