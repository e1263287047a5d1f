import math
import random

import pytest
from brute import SF
from llm_oracle import same
from pyspark.sql import functions as F

from stratalens.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, limit=5):
    """The contract's rows by all pairs, in Python's integers."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for k, (i, v, label) in enumerate(own):
        if i is None or i % 100:
            continue
        met = [(dot(v, w), j, other) for m, (j, w, other) in enumerate(own) if m != k and len(w) == len(v)]
        for nth, (p, j, _) in enumerate(sorted((x for x in met if x[2] == label), key=lambda x: (-x[0], last(x[1])))[:5]):
            fits = sorted((x for x in met if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=lambda x: (-x[0], last(x[1])))
            out += [(i, j, rank, n, p, s, nth + 1) for rank, (s, n, _) in enumerate(fits[:limit], 1)]
    return out


def told(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect()), key=repr)


def rows(n, dim=6, seed=1, step=0.25):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1) / step) * step for _ in range(dim)], rng.randrange(3)) for i in range(n)]


def test_same_as_sql(spark):
    same(queries.op13_hard_negatives(spark, SF), queries.oracle_sql()["op13_hard_negatives"], SF)


def test_query_against_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = told(queries.op13_hard_negatives(spark, SF))
    assert got and got == sorted(plain([(r.vec_id, [float(x) for x in r.embedding], r.label) for r in table.collect()]), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_many_ties_over_one_cell_or_many(spark, block_bytes):
    data = rows(500, step=1.0)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = told(negatives.mined(df, block_bytes=block_bytes))
    assert len(got) > 50 and got == sorted(plain(data), key=repr)


def test_odd_rows(spark):
    data = rows(220, dim=3, seed=2)
    data += [(100, [1.0, 0.5, 2.0], 1)] * 4 + [(None, [2.0, 2.0, 2.0], 1), (None, [2.0, 2.0, 2.0], 0), (300, None, 1), (400, [1.0, None, 1.0], 1), (500, [1.0, float("nan"), 0.0], 1)]
    data += [(600, [float("inf"), 1.0, 1.0], 1), (700, [1.0, 1.0, 1.0], None), (800, [1.0, 2.0], 1), (801, [1.0, 2.0], 1), (802, [1.0, 1.8], 2), (900, [], 1), (901, [], 1), (902, [], 2), (1100, [0.0, 0.0, 0.0], 1), (-100, [1.0, 1.0, 1.0], -3)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("uid", "score", "_row", "_column", "positives")})
    assert told(negatives.digest(df)) == sorted(plain(data), key=repr)


def test_a_label_of_a_third_of_all_rows_and_copies(spark):
    data = rows(300, dim=4, seed=3) + [(1000 + i, [1.0, 1.0, 0.0, 0.5], 1) for i in range(200)]
    got = told(negatives.mined(spark.createDataFrame(data, SCHEMA), block_bytes=2000))
    assert got == sorted(plain(data), key=repr)


def test_products_past_float64_are_exact(spark):
    rng = random.Random(4)
    data = [(i, [rng.uniform(-1, 1) * 2**22 for _ in range(4)], rng.randrange(2)) for i in range(205)]
    assert max(abs(s) for *_, s, _ in plain(data)) > 2**53
    assert told(negatives.digest(spark.createDataFrame(data, SCHEMA))) == sorted(plain(data), key=repr)


def test_empty(spark):
    assert negatives.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.digest(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).count() == 0
