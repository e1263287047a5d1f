import re
from collections import Counter

import pytest
from brute import SF
from pyspark.sql import functions as F
from stratalens.llm import mixing as M
from stratalens.llm.queries import op3_source_mix


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes):
    """Targets of the sources, by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, capped = {s: 0.0 for s in names}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        heavy = sum(weight[s] for s in free) or 1
        goal = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / heavy for s in names}
        over = [s for s in free if goal[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return goal
        capped |= set(over)


def check(got, docs):
    """docs: (id, text, source) of every row."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += words(t)
    goal = water(sizes)
    assert sorted(map(str, ((r.doc_id, r.size) for r in got))) == sorted(map(str, ((d, words(t)) for d, t, _ in docs)))
    by_id = {d: s for d, _, s in docs}
    taken = Counter()
    block = max(1, -(-1.5 * sum(sizes.values()) // (M.SLOTS * len(sizes))))
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 8 * block + 0.01 * goal[s], (s, taken[s], goal[s])


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op3_source_mix(spark, SF).collect()
    check(got, docs)
    assert sorted(got) == sorted(op3_source_mix(spark, SF).collect())


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", None), (3, "x " * 20_000, "b"), (4, "one two", "b"), (4, "one two", "b"), (None, "w " * 30, None), (6, "q", "é"), (7, " ", "zero")]
    docs += [(10 + i, "v " * (i % 40), "hot") for i in range(900)]
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, source string, row string, rank int")
    check(M.digest(df).collect(), docs)
    assert M.digest(df.where("false")).count() == 0
    assert {r.taken for r in M.digest(df.where("size(split(text, ' ')) < 2")).collect()} <= {0, 1, 2}
    mixed = M.mixed(df)
    assert mixed.columns == df.columns
    most = Counter(r.doc_id for r in mixed.collect())
    assert most[3] and most[7] == 0 and max(v for d, v in most.items() if d != 4) == 2


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([(i, f"s{i % 7}", 50, i) for i in range(700)], "doc_id long, source string, size long, row long")
    of = M.targets(sizes)
    goal = {r.rank: r.target / r.total for r in of.collect()}
    slots = sorted((r.slot, r.rank, r.block) for r in M.schedule(of).collect())
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    seen = Counter()
    for n, (_, rank, block) in enumerate(slots, 1):
        assert block == seen[rank]
        seen[rank] += 1
        if n % 500 == 0:
            assert all(abs(seen[k] - goal[k] * n) < 8 for k in goal)


def test_small_source_beside_large_ones(spark):
    # 64-bit sizes stand in for texts: blocks grow with the corpus, the small source does not
    sizes = {f"s{i:02}": 200_000_000 for i in range(20)}
    for name in ("a", "s05x", "z"):
        for small in (3, 200, 20_000):
            held = {**sizes, name: small}
            df = spark.createDataFrame([(i, s, n, i) for i, (s, n) in enumerate(sorted(held.items()))], "doc_id long, source string, size long, row long")
            of = M.targets(df).cache()
            goal = {r.rank: r.target for r in of.collect()}
            slots = M.schedule(of).groupBy("rank").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.max("block").alias("last")).collect()
            assert {r.rank: r.words for r in slots} == {k: round(v) for k, v in goal.items()}
            assert all(r.last == r.n - 1 for r in slots)


def test_every_source_to_its_target(spark):
    docs = [(i, "w " * 4000, f"s{i % 20:02}") for i in range(400)] + [(1000 + i, "one two", "s07x") for i in range(3)] + [(2000, "x", "tiny")]
    got = M.digest(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    source = {d: s for d, _, s in docs}
    taken, goal = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert dict(taken) == {s: round(g) for s, g in goal.items()}


def test_a_row_of_many_copies(spark):
    docs = [(5, "a b c", "hot")] * 20_000 + [(100 + i, "w " * (i % 50), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    check(M.digest(df).collect(), docs)
    sizes = M.sized(df).cache()
    of = M.targets(sizes)
    goals = of.join(M.schedule(of).groupBy("rank").agg(F.count("*").alias("held")), "rank").withColumn("goal", M.whole_target())
    placed = M.streams(sizes, goals).where("doc_id = 5")
    # the copies fill their stretch without gaps, and no partition holds them all
    assert sorted(r.start for r in placed.collect()) == list(range(0, 60_000, 3))
    assert max(map(len, placed.rdd.glom().collect())) < 15_000


def test_schedule_is_planned_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = M.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" in plan
