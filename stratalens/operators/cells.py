"""Exact search that reads a part of the points: a layout by coarse centroids with bounds on the cosine.

Points lie in the cell of their nearest centroid, one Parquet partition for each cell.  Of a cell its least and
greatest angle to the centroid are kept.  By the triangle inequality of angles, a query at angle t to the
centroid is at least max(t - greatest, least - t, 0) from every point of the cell, so the cosine of that is an
upper bound on their scores.  A search first scores its nearest cell; then only cells whose bound
reaches the score of the last result so far can hold a better one, and no others are read.

The centroids are fitted by k-means on a bounded sample (PER_CELL points for each cell, chosen by a hash of the id); they decide how much
is read, never what is found.  There are at most CELLS of them, and at most CENTROID_BYTES in all, so they are sent to
every task; figures of cells are collected, those of points or queries never.  Queries and points of a cell meet in
a grid of blocks of bounded size, so neither a cell with a third of all points nor one that all queries ask for is one task's alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stratalens.operators import grid, search, shared

#: Cells at most, bytes of all centroids at most, and points of the sample for each cell.
CELLS, CENTROID_BYTES, PER_CELL = 4096, 16 << 20, 64
#: Added to a bound, far above the rounding of scores and angles.
SLACK = 1e-7
#: The cell of points whose vectors have another length than the centroids; they are read for queries of other lengths only.
ODD = -1
SEED = 17


def fitted(points: DataFrame, cells: int | None = None) -> np.ndarray:
    """Unit centroids for the commonest length of the points' vectors; about the square root of their number by default."""
    sizes = points.where("unit_vector IS NOT NULL").groupBy(F.size("unit_vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes or not sizes[0].n:
        return np.zeros((0, 0))
    size, count = sizes[0]
    k = min(cells or int(count**0.5) + 1, CELLS, max(1, CENTROID_BYTES // (8 * size)), count)
    share = min(1.0, PER_CELL * k / count)
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "point_id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))
    sample = shared.kept(points.where((F.size("unit_vector") == size) & chosen).select("point_id", "unit_vector"))
    if not sample.limit(1).count():
        sample = points.where(F.size("unit_vector") == size).limit(1)
    if k < 2:
        return np.array([sample.select("unit_vector").first()[0]])
    model = KMeans(k=k, seed=SEED, maxIter=10, initSteps=2, distanceMeasure="cosine").fit(sample.select(array_to_vector("unit_vector").alias("features")))
    centers = np.array(model.clusterCenters())
    lengths = np.linalg.norm(centers, axis=1, keepdims=True)
    return centers[lengths[:, 0] > 0] / lengths[lengths[:, 0] > 0]


def angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1.0, 1.0))


def _assign(centroids: np.ndarray):
    """For ``mapInArrow``: the batch with each point's cell and its angle to the centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.full(b.num_rows, ODD, np.int32), np.zeros(b.num_rows)
            for n, (rows, vectors) in grid.by_length(b.column("unit_vector")).items():
                if n == centroids.shape[1] and n:
                    for at in np.array_split(np.arange(len(rows)), max(1, len(rows) * len(centroids) // grid.AREA + 1)):
                        away = angles(vectors[at], centroids)
                        cell[rows[at]] = away.argmin(axis=1)
                        angle[rows[at]] = away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return run


class CellIndex:
    """The points of a folder that ``build`` has laid out; immutable, whole once its last table is complete."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        kept = sorted(spark.read.parquet(f"{self.path}/centroids").collect(), key=lambda r: r.cell)  # of CENTROID_BYTES at most
        self.centroids = np.array([r.centroid for r in kept]) if kept else np.zeros((0, 0))
        figures = {r.cell: r for r in spark.read.parquet(f"{self.path}/cells").collect()}  # a row for each cell
        self.rows = {c: r.rows for c, r in figures.items()}
        self.total = sum(self.rows.values())
        self.spans = np.array([(figures[c].low, figures[c].high) if c in figures else (np.nan, np.nan) for c in range(len(self.centroids))]).reshape(-1, 2)

    @classmethod
    def build(cls, points: DataFrame, path: str, cells: int | None = None) -> CellIndex:
        """Lay out (point_id, unit_vector, payload) below ``path``; points without a direction have no score and are left out."""
        spark = points.sparkSession
        points = points.where("unit_vector IS NOT NULL").select("point_id", "unit_vector", "payload")
        centroids = fitted(points, cells)
        schema = StructType([*points.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
        laid = points.mapInArrow(_assign(centroids), schema)
        laid.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/points")  # a large cell is several tasks'
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
        figures = spark.read.schema(schema).parquet(f"{path}/points").groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        figures.coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def points(self, cells: list[int] | None = None) -> DataFrame:
        """The points of all or the given cells; the partitions of others are not read."""
        schema = f"point_id string, unit_vector array<double>, payload {self._payload()}, angle double, cell int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/points")
        return rows if cells is None else rows.where(F.col("cell").isin(cells) if cells else F.lit(False))

    def _payload(self) -> str:
        if not hasattr(self, "_kind"):
            found = self.spark.read.parquet(f"{self.path}/points").schema if self.total else None
            self._kind = found["payload"].dataType.simpleString() if found else "struct<document_family:string,release_label:string,source_kind:string>"
        return self._kind

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """For each unit vector and cell, what no score of the cell's points is above; the last column is the ODD cell's."""
        out = np.full((len(vectors), len(self.centroids) + 1), -np.inf)
        if not len(self.centroids) or vectors.shape[1] != self.centroids.shape[1]:
            out[:, -1] = np.inf if ODD in self.rows else -np.inf
            return out
        away = angles(vectors, self.centroids)
        gap = np.maximum(np.maximum(away - self.spans[:, 1], self.spans[:, 0] - away), 0.0)
        out[:, :-1] = np.where(np.isnan(self.spans[:, 0]), -np.inf, np.cos(gap) + SLACK)
        return out

    def search(self, query_vector: list[float], limit: int = 5, **filters: str | None) -> DataFrame:
        """``search.search`` over the cells that may hold a result."""
        vector = np.array(query_vector, float)
        length = np.linalg.norm(vector)
        if not length:
            return search.search(self.points([]), query_vector, limit, **filters)
        bound = self.bounds((vector / length)[None])[0]
        nearest = int(bound.argmax())
        first = search.search(self.points([self._cell(nearest)]), query_vector, limit, **filters).select("score").collect()  # limit rows
        least = min((r.score for r in first), default=-np.inf) if len(first) == limit else -np.inf
        return search.search(self.points([self._cell(int(c)) for c in np.flatnonzero((bound >= least) & (bound > -np.inf))]), query_vector, limit, **filters)

    def _cell(self, column: int) -> int:
        return ODD if column == len(self.centroids) else column

    def _asked(self, queries: DataFrame, least: str | None) -> DataFrame:
        """(query, cell) rows: each query's nearest cell, or with ``least`` all other cells whose bound reaches that column."""
        own = CellIndex.__new__(CellIndex)  # without the session, for the tasks
        own.centroids, own.spans, own.rows = self.centroids, self.spans, self.rows
        count = len(self.centroids)
        fields = [f for f in queries.schema.fields if f.name != least]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, (at, vectors) in grid.by_length(b.column("_q")).items():
                    for part in np.array_split(np.arange(len(at)), max(1, len(at) * (count + 1) // grid.AREA + 1)):
                        bound = own.bounds(vectors[part])
                        which = bound.argmax(axis=1)
                        if least is None:
                            row = np.flatnonzero(bound.max(axis=1) > -np.inf)
                            cell = which[row]
                        else:
                            floor = b.column(least).take(pa.array(at[part])).to_numpy(zero_copy_only=False)
                            bound[np.arange(len(part)), which] = -np.inf  # already scored
                            row, cell = np.nonzero((bound >= floor[:, None]) & (bound > -np.inf))
                        cell = np.where(cell == count, ODD, cell).astype(np.int32)
                        taken = b.select([f.name for f in fields]).take(pa.array(at[part][row]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell)], names=[*taken.schema.names, "cell"])

        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        return queries.mapInArrow(run, f"{ddl}, cell int")

    def _scored(self, asked: DataFrame, limit: int, width: int, block_bytes: int) -> DataFrame:
        """(query_id, point_id, score) of the asked cells, the best of each of their blocks."""
        counts = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row for each cell
        blocks = lambda n: max(1, -(-n * max(width, 1) * 8 // block_bytes))
        sizes = [(c, blocks(n), blocks(self.rows[c])) for c, n in counts.items()]
        shape = F.broadcast(self.spark.createDataFrame(sizes, "cell int, rows int, columns int"))  # a row for each cell
        points = self.points(sorted(counts)).select("point_id", "unit_vector", *[F.col(f"payload.{f}").cast("string").alias(f) for f in search.FILTERS], "cell")
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, point_id string, score double"
        return grid.met(
            asked.join(shape, "cell"), points.join(shape, "cell"), F.col("query_id"), F.col("point_id"), "rows", "columns", search.nearest(limit), schema,
            on=("cell",), cells=max(1, sum(r * c for _, r, c in sizes)),
        )

    def searched(self, queries: DataFrame, limit: int = 5, block_bytes: int = grid.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
        """(hits, reads): the rows of ``search.search_many``, and (query_id, cells_read, rows_read, share) for each query with a direction."""
        if limit <= 0:
            raise ValueError("limit must be greater than 0")
        asked = search.prepared(queries)
        width = asked.agg(F.coalesce(F.max(F.size("_q")), F.lit(0))).first()[0]
        near = shared.kept(self._asked(asked, None))
        first = shared.kept(self._scored(near, limit, width, block_bytes))
        # per query, the score of the last result so far; none where there are fewer than asked for
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        floors = first.select(F.col("query_id").alias("_id"), F.col("score").alias("_least"), nth.alias("_nth")).where(F.col("_nth") <= limit).where(F.col("_nth") == limit)
        known = asked.join(floors, F.col("query_id").eqNullSafe(F.col("_id")), "left").select(asked["*"], F.coalesce("_least", F.lit(float("-inf"))).alias("_least"))
        rest = shared.kept(self._asked(known, "_least"))
        found = first.unionByName(self._scored(rest, limit, width, block_bytes))
        rows = self.spark.createDataFrame(list(self.rows.items()) or [], "cell int, rows long")
        read = near.select("query_id", "cell").unionByName(rest.select("query_id", "cell")).join(F.broadcast(rows), "cell")
        reads = read.groupBy("query_id").agg(F.count("*").alias("cells_read"), F.sum("rows").alias("rows_read")).withColumn("share", F.col("rows_read") / F.lit(max(self.total, 1)))
        return search.ranked(found, self.points(), limit), reads

    def search_many(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        return self.searched(queries, limit)[0]
