import re

import numpy as np
from pyspark.sql import functions as F

from stratalens.llm import simhash as S
from stratalens.llm.common import components, word_count
from stratalens.llm.filters import wanted


def test_small_graphs_are_put_together_by_one_task(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(i, 700) for i in range(600, 690)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if x != r}
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        alone, dealt = components(edges), components(edges, few=0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {r.node: r.root for r in alone.collect()} == {r.node: r.root for r in dealt.collect()} == want
    assert alone.rdd.getNumPartitions() == 1
    assert components(edges.where("false")).count() == 0


def test_filter_of_repeated_places(spark):
    places = spark.createDataFrame([(i, i % 3) for i in range(5000)], "o long, line int")
    assert (wanted(places.union(places), 5000) == wanted(places)).all()


def test_words_are_counted_without_a_list_of_them(spark):
    texts = [None, "", " ", " \t\n", "a", " a b", "a b\x0b\x0cc\r\n d  ", "x\x1cy \x85 z", "\U0001F600 é", "w " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", word_count(F.col("text")).alias("n"))
    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_few_pairs_are_verified_where_the_sets_lie(spark):
    have = spark.createDataFrame([(i, [i // 2, 10_000 + i // 2]) for i in range(400)], "node long, held array<long>").repartition(4)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (8, 9)], "u long, v long")
    found = S._verified(pairs, have, S.LEAST)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (8, 9)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert S._verified(pairs.where("false"), have, S.LEAST).count() == 0
