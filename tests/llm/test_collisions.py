import math

import numpy as np
from brute import SF
from stratalens.llm import collisions as C
from stratalens.llm.queries import op9_embedding_near_dedup


def brute(rows):
    """rows: (id, vector, label). Returns n_links and component of each row."""
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str((d, links[i], least.get(find(i)))) for i, (d, _, _) in enumerate(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + rng.standard_normal(16) * 0.02], i % 2) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0], 7) for i in range(30)] + [(200, [2.0, 4.0, 6.0], 7), (None, [1.0, 2.0, 3.0], 7), (201, [1.0, 2.0, 3.0], None)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] + [1.0] * 15, 1), (305, [None] + [1.0] * 15, 1), (306, None, None)]
    rows += [(2**62 + 1, [1.0, 0.0], 9), (2**62 + 1, [1.0, 0.0], 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    for block in (1024, 7):
        got = C.near_duplicates(df, block=block).collect()
        assert sorted(str((r.id, r.n_links, r.component)) for r in got) == brute(rows)
    assert C.digest(df.where("false")).count() == 0
    assert {r.vec_id for r in C.digest(df).collect() if not r.kept} >= {101, None}


def test_recall_at_the_limit():
    rng = np.random.default_rng(5)
    a = C.units(rng.standard_normal((1500, 64)))
    b = C.units(rng.standard_normal((1500, 64)))
    b = C.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = 0.9801 * a + math.sqrt(1 - 0.9801**2) * b
    i, j = C.compare(a, c)
    assert (i == j).sum() >= 0.98 * len(a) and (i == j).all()
    below = 0.9799 * a + math.sqrt(1 - 0.9799**2) * b
    assert not len(C.compare(a, below)[0])


def test_plan_and_cells():
    assert C.plan(10) == (0, 1) and C.plan(C.CELL) == (0, 1)
    for n in (10**3, 10**5, 10**7):
        folds, tables = C.plan(n)
        assert n * C.shared(math.sqrt(2)) ** folds <= C.CELL and 1 - (1 - C.shared(C.distance(C.LEAST)) ** folds) ** tables >= C.RECALL
    rng = np.random.default_rng(8)
    a = C.units(rng.standard_normal((2000, 48)))
    b = C.units(rng.standard_normal((2000, 48)))
    b = C.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    near = 0.98 * a + math.sqrt(1 - 0.98**2) * b
    folds, tables = C.plan(10**5)
    met = (C.cells(a, folds, tables) == C.cells(near, folds, tables)).any(axis=1)
    assert met.mean() >= 0.98


def test_recall_over_cells(spark):
    """Of one label large enough for several tables: all found links are links, and nearly all links at the limit are found."""
    rng = np.random.default_rng(9)
    n, dim = 1500, 24
    a = C.units(rng.standard_normal((n, dim)))
    b = C.units(rng.standard_normal((n, dim)))
    b = C.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    every = np.concatenate((a, 0.9801 * a + math.sqrt(1 - 0.9801**2) * b))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    assert C.plan(2 * n)[1] > 1
    got = {r.id: (r.n_links, r.component) for r in C.near_duplicates(df, block=40).collect()}
    sims = every @ every.T >= 0.98
    true = sims.sum(axis=1) - 1
    assert all(got[i][0] <= true[i] for i in range(2 * n))
    assert sum(v for v, _ in got.values()) >= 0.97 * true.sum()


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op9_embedding_near_dedup(spark, SF).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
