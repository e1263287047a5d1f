import numpy as np
import pandas as pd
from brute import SF
from pyspark.sql import functions as F
from stratalens.llm import quality as Q
from stratalens.llm.queries import op2_quality_classifier

cotrain = Q.cotrain
WIDE = "/root/testdata/sf0.01"
COLS = "doc_id long, text string, lang string, source string, n_chars long, keep string, score int"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{WIDE}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.quality for r in labels.collect()}
    train = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in Q.scored(docs, train).collect()}
    held = [d for d in y if d % 2 and d in got]
    assert np.mean([got[d].keep == (y[d] == 1) for d in held]) > 0.95
    assert np.mean([got[d].keep for d in held if y[d] == 1]) > 0.98
    again = {r.doc_id: r for r in Q.scored(docs, train).collect()}
    assert got == again


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{WIDE}/labels.parquet")
    docs = spark.read.parquet(f"{WIDE}/documents.parquet").selectExpr("*", "'k' AS keep", "1 AS score")
    odd = spark.createDataFrame([(None, None, None, None, None, "k", 1), (-1, "", "", "", 0, "k", 1), (-2, "x" * 80_000, "xx", "zz", -5, None, None), (-2, "x" * 80_000, "xx", "zz", -5, None, None)], COLS)
    both = docs.select(*odd.columns).union(odd)
    got = Q.scored(both, labels).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == -2}) == 1
    kept = Q.kept(both, labels)
    assert kept.columns == both.columns and kept.count() == sum(r.keep for r in got)
    assert Q.scored(both.where("false"), labels).count() == 0


def test_without_usable_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    for labels in (one, one.where("false")):
        got = Q.scored(docs, labels).collect()
        assert len(got) == docs.count() and all(r.keep and r.score is None for r in got)


def test_query(spark):
    got = op2_quality_classifier(spark, SF)
    assert got.columns == ["doc_id", "text_score", "meta_score", "score", "keep"] and got.count() == 200


def test_labels_used_do_not_fall_as_the_corpus_grows(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{WIDE}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(Q, "cotrain", lambda a, b, y: seen.append(np.bincount(y + 1, minlength=3).tolist()) or cotrain(a, b, y))
    more = docs.crossJoin(spark.range(1, 21)).select((docs.doc_id + F.col("id") * 1_000_000).alias("doc_id"), *docs.columns[1:])
    sample = 2 * labels.count()
    for every in (docs, docs.unionByName(more)):
        assert Q.fit(every, labels, sample) is not None
    known = {d.doc_id for d in docs.select("doc_id").collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in known}
    assert [s[1:] for s in seen] == [[sum(v == c for v in y.values()) for c in (0, 1)]] * 2
    assert 0 < seen[0][0] <= seen[1][0] <= 1.2 * sample


def test_labels_are_bounded_by_kind(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{WIDE}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(Q, "cotrain", lambda a, b, y: seen.append(np.bincount(y + 1, minlength=3).tolist()))
    Q.fit(docs, labels, 100)
    bad = labels.join(docs, "doc_id").where("quality = 0").count()
    assert 25 <= seen[0][2] <= 80 and min(bad, 50) / 2 <= seen[0][1] <= 80


def test_few_labels_of_a_kind():
    rng = np.random.default_rng(3)
    for y in ([0, 1, 1, 0, 1, 1, 1], [1, 1, 0, 0, 1, 1, 1]):
        x = np.array(y)[:, None] + rng.normal(0, 0.1, (7, 2))
        assert Q.cotrain(x, x, np.array(y)) is not None


def test_rounds_help():
    """On two views that are independent given the label, with few labels."""
    gain = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 3000)
        a, b = [(2 * y[:, None] - 1) * 0.5 + rng.standard_normal((3000, 60)) * 1.3 for _ in range(2)]
        few = np.where(np.arange(3000) < 240, y, -1)
        right = [np.mean((Q.cotrain(a, b, few, rounds).text.chance(a)[240:] > 0.5) == y[240:]) for rounds in (0, 3)]
        gain.append(right[1] - right[0])
    assert np.mean(gain) > 0.0005 and min(gain) > -0.001


def test_a_view_of_noise_teaches_nothing():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    a, b = (2 * y[:, None] - 1) + rng.standard_normal((2000, 8)) * 0.5, rng.standard_normal((2000, 60))
    few = np.where(np.arange(2000) < 200, y, -1)
    assert np.mean((Q.cotrain(a, b, few).score(a, b) > 0.5) == y) > 0.99
    assert Q.trusted(np.array([0.99] * 9), np.ones(9)) == (False, False) and Q.trusted(np.array([0.99] * 10 + [0.01] * 12), np.array([1] * 10 + [0] * 12)) == (True, True)


def test_exchange_against_a_plain_loop():
    rng = np.random.default_rng(5)
    free, chances = rng.permutation(500)[:300], np.round(rng.random(300), 3)
    known = rng.permutation(500)[:100]
    rows, labels = Q.exchanged(chances, free, known)
    want = []
    for i, p in sorted(zip(free.tolist(), chances.tolist()), key=lambda x: -abs(x[1] - 0.5)):
        if i not in known and (p >= Q.SURE or p <= 1 - Q.SURE):
            want.append((abs(p - 0.5), i, int(p > 0.5)))
    most = int(Q.GIVEN * 300) + 1
    got = list(zip(rows.tolist(), labels.tolist()))
    assert len(got) == min(most, len(want)) and {x[1:] for x in want} >= set(got)
    assert sorted(abs(chances[list(free).index(i)] - 0.5) for i, _ in got) == sorted(w[0] for w in want[:most])


def test_views_are_separate():
    assert Q.metadata_view("en", "s", 5).shape == (Q.META,) and Q.text_view("one two").shape == (Q.TEXT,)
    texts = ["a b\nc", None, "", "x " * 300, "\n\n", "é!! É$$ 1"]
    both = Q.text_views(pd.Series(texts, dtype=object))
    assert all((both[i] == Q.text_view(t)).all() for i, t in enumerate(texts))


def test_features_pass_the_driver_by_partition(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{WIDE}/{t}.parquet") for t in ("documents", "labels"))
    kind, sent, given = type(docs), [], []
    to_arrow = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: sent.append(to_arrow(self)) or sent[-1])
    monkeypatch.setattr(Q, "cotrain", lambda a, b, y: given.append((a, b, y)))
    Q.fit(docs, labels)
    a, b, y = given[0]
    assert 0 < sum(t.nbytes for t in sent) < a.nbytes / 20
    # all rows, in the order of their keys, each with its own features
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").collect()
    known = {r.doc_id: r.low for r in known}
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select("*", key.alias("key")).dropDuplicates().collect()
    rows = sorted(rows, key=lambda r: (r.key, known.get(r.doc_id, -1)))
    assert len(rows) == len(a) == len(b) and [known.get(r.doc_id, -1) for r in rows] == y.tolist()
    assert np.array_equal(a, Q.text_views(pd.Series([r.text for r in rows], dtype=object)))
    assert np.array_equal(b, np.stack([Q.metadata_view(r.lang, r.source, r.n_chars) for r in rows]))
