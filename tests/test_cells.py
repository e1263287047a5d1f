import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import embedding, search
from stratalens.operators.cells import ODD, CellIndex

RNG = np.random.default_rng(8)


def points(spark, vectors, fields=lambda i: (f"FS_{i % 2}", f"R{i % 5}", "table" if i % 3 else "paragraph")):
    rows = [(f"p{i:06d}", None if v is None else [float(x) for x in v], fields(i)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "point_id string, vector array<double>, payload struct<document_family:string,release_label:string,source_kind:string>")
    return df.withColumn("unit_vector", embedding.unit(F.col("vector")))


def clustered(n, k=40, dim=16, noise=0.08):
    centers = RNG.normal(size=(k, dim))
    return centers[np.arange(n) % k] + noise * RNG.normal(size=(n, dim))


def asked(spark, vectors, filters=lambda i: (None, None)):
    rows = [(i, [float(x) for x in v], *filters(i)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id long, query_vector array<double>, release_label string, source_kind string")


def told(df):
    return sorted((r.query_id, r["rank"], r.point_id, r.score, r.payload) for r in df.collect())


def test_clustered_points_are_found_by_reading_a_small_part(spark, tmp_path):
    vectors = clustered(6000)
    pts, queries = points(spark, vectors), asked(spark, vectors[::100])
    index = CellIndex.build(pts, str(tmp_path / "cells"), cells=60)
    hits, reads = index.searched(queries)
    assert told(hits) == told(search.search_many(pts, queries))
    share = {r.query_id: r.share for r in reads.collect()}
    assert len(share) == 60 and sum(share.values()) / 60 < 0.2
    assert index.total == 6000 and index.points().count() == 6000


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_any_points_and_filters(spark, tmp_path, block_bytes):
    vectors = [*RNG.normal(size=(300, 5)), *[[1.0, 0, 0, 0, 0]] * 150, *RNG.integers(-1, 2, (50, 5)), *RNG.normal(size=(4, 3)), None, [0.0] * 5, []]
    pts = points(spark, vectors)
    wanted = [*RNG.normal(size=(20, 5)), [1.0, 0, 0, 0, 0], [0.0] * 5, [1.0, 2.0, 3.0], [1.0], [-1.0, 0, 0, 0, 0]]
    queries = asked(spark, wanted, lambda i: (f"R{i % 5}" if i % 3 == 1 else None, "table" if i % 4 == 1 else "none" if i == 6 else None))
    index = CellIndex.build(pts, str(tmp_path / "cells"), cells=9)
    assert index.rows[ODD] == 4 and index.total == sum(v is not None and any(v) for v in vectors)
    hits, reads = index.searched(queries, 4, block_bytes)
    assert told(hits) == told(search.search_many(pts, queries, 4))
    assert {r.query_id: r.cells_read for r in reads.collect()}[22] == 1


def test_bounds_hold(spark, tmp_path):
    vectors = RNG.normal(size=(400, 6))
    index = CellIndex.build(points(spark, vectors), str(tmp_path / "cells"), cells=12)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    queries = unit(RNG.normal(size=(50, 6)))
    bound = index.bounds(queries)
    for r in index.points().collect():
        assert (queries @ np.array(r.unit_vector) <= bound[:, r.cell]).all()


def test_one_query(spark, tmp_path):
    vectors = clustered(2000, noise=0.05)
    pts = points(spark, vectors)
    index = CellIndex.build(pts, str(tmp_path / "cells"), cells=40)
    for filters in ({}, {"release_label": "R2"}, {"release_label": "none"}):
        rows = lambda df: [(r["rank"], r.point_id, r.score) for r in df.collect()]
        assert rows(index.search(list(vectors[7]), 3, **filters)) == rows(search.search(pts, list(vectors[7]), 3, **filters))
    assert index.search([0.0] * 16).count() == 0
    plan = index.search(list(vectors[7]), 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan)


def test_empty(spark, tmp_path):
    pts = points(spark, [[1.0, 2.0]])
    index = CellIndex.build(pts.limit(0), str(tmp_path / "none"))
    assert index.search_many(asked(spark, [[1.0, 2.0]])).count() == 0 and index.search([1.0, 2.0]).count() == 0
    index = CellIndex.build(pts, str(tmp_path / "one"))
    assert index.search_many(asked(spark, [[1.0, 2.0]])).count() == 1 and index.search_many(asked(spark, [[1.0, 2.0]]).limit(0)).count() == 0
