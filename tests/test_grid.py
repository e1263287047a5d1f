import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.operators import grid


def test_every_left_row_meets_every_right_row_once(spark):
    left, right = spark.range(23), spark.range(100, 157)

    def pairs(a, b):
        x, y = a["id"].to_numpy(), b["id"].to_numpy()
        return pa.table({"a": np.repeat(x, len(y)), "b": np.tile(y, len(x))})

    for shape in ((1, 1), (3, 1), (2, 5)):
        got = sorted(map(tuple, grid.met(left, right, F.col("id"), F.col("id"), *shape, pairs, "a long, b long").collect()))
        assert got == [(a, b) for a in range(23) for b in range(100, 157)]


def test_a_table_meets_itself(spark):
    rows = spark.range(9)
    count = lambda a, b: pa.table({"n": [a.num_rows * b.num_rows]})
    assert sum(r.n for r in grid.met(rows, rows.where("id < 4"), F.col("id"), F.col("id"), 2, 2, count, "n long").collect()) == 36


def test_an_empty_side(spark):
    count = lambda a, b: pa.table({"n": [a.num_rows * b.num_rows]})
    out = grid.met(spark.range(3), spark.range(0), F.col("id"), F.col("id"), 2, 2, count, "n long")
    assert sum(r.n for r in out.collect()) == 0


def test_shape_follows_bytes(spark):
    assert grid.shape(spark, 10, 10, 512) == (1, 1)
    assert grid.shape(spark, 10, 9000, 512) == (1, 2)
    assert grid.shape(spark, 10**6, 10**8, 512) == (31, 3052)
    assert grid.shape(spark, 0, 0, 0) == (1, 1)


def test_by_length():
    lists = pa.chunked_array([pa.array([[1.0, 2.0], None, [], [3.0]]), pa.array([[4.0, 5.0]])])
    got = {n: (rows.tolist(), m.tolist()) for n, (rows, m) in grid.by_length(lists).items()}
    assert got == {0: ([2], [[]]), 1: ([3], [[3.0]]), 2: ([0, 4], [[1.0, 2.0], [4.0, 5.0]])}
    assert grid.by_length(pa.array([], pa.list_(pa.float64()))) == {}
    assert grid.by_length(pa.array([[], []], pa.list_(pa.float64())))[0][1].shape == (2, 0)
    sliced = pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]]).slice(1)
    assert grid.by_length(sliced)[2][1].tolist() == [[1.0, 2.0], [3.0, 4.0]]


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_leading_and_first_of(kind):
    rng = np.random.default_rng(5)
    scores = rng.integers(-4, 5, (40, 60)).astype(kind)
    fits = rng.random((40, 60)) < 0.4
    fits[7] = False
    at, to = grid.leading(scores, fits, 5)
    kept = grid.first_of([at], [-scores[at, to], to], 5)
    got = {}
    for i, j in zip(at[kept].tolist(), to[kept].tolist()):
        got.setdefault(i, []).append(j)
    assert got == {i: sorted(np.flatnonzero(fits[i]).tolist(), key=lambda j: (-scores[i, j], j))[:5] for i in range(40) if fits[i].any()}


def test_tiles_cover():
    seen = np.zeros((70, 301), int)
    for i, j in grid.tiles(70, 301, 640):
        assert seen[i, j].size <= 640
        seen[i, j] += 1
    assert (seen == 1).all()
