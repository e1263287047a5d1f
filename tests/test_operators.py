import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalens.operators import answer, chunking, embedding, evaluation, evidence, index, search
from stratalens.schemas import PAYLOAD, RECORD_FIELDS, TABLES


def record(unit, status="embedded", vector=(0.1, 0.2), key=None, family="FS_A", release="R1", kind="paragraph", text="text"):
    return (unit, 0, kind, family, release, "h", "v1", key or f"key-{unit}", text, "m", status, [float(x) for x in vector] if vector else None)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD_FIELDS)


def docs(spark, *rows):
    return spark.createDataFrame([(n, "FS_A", "R1", p, t) for n, p, t in rows], f"document_name string, document_family string, release_label string, paragraphs array<string>, tables {TABLES}")


def test_units(spark):
    df = docs(spark, ("d", [f"p{i}" for i in range(7)] + ["", "Reviewers"], [[["a", "b"], ["c"]], [[""]], [["", ""]], [[" x  y "]]]), ("empty", [], []))
    got = sorted((r.unit_id, r.unit_index, r.source_kind, r.text) for r in chunking.ingested(df).collect())
    assert got == [
        ("d::chunk_0", 0, "paragraph", "p0\np1\np2\np3\np4"), ("d::chunk_1", 1, "paragraph", "p5\np6"), ("d::table_chunk_0", 2, "table", "a | b\nc"),
        ("d::table_chunk_2", 3, "table", " | "), ("d::table_chunk_3", 4, "table", "x y"),
    ]
    counts = chunking.normalized(df).where("document_name = 'd'").first()
    assert (counts.original_non_empty_paragraph_count, counts.cleaned_paragraph_count, counts.removed_paragraph_count) == (8, 7, 1)
    table = chunking.described_tables(df).where("document_name = 'd'").first().tables[0]
    assert (table.row_count, table.column_count) == (2, 2)
    with pytest.raises(ValueError, match="max_paragraphs_per_chunk"):
        chunking.chunk_paragraphs(chunking.normalized(df), 0)


def test_units_do_not_shuffle(spark):
    plan = chunking.ingested(docs(spark, ("d", ["p"], [])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_cache(spark):
    held = records(spark, record("a"), record("b", "cached"), record("c", "pending", None))
    assert {r.cache_key for r in embedding.usable(held).collect()} == {"key-a", "key-b"}
    twice = records(spark, record("a", key="k", release="R1"), record("b", key="k", release="R2"))
    assert embedding.last_wins(twice, ["unit_id"]).first().release_label == "R2"
    torn = records(spark, record("a", key="k"), record("b", key="k", vector=(9.9, 9.8)))
    with pytest.raises(Exception, match="Conflicting cached vectors"):
        embedding.last_wins(torn, ["unit_id"]).collect()
    asked = records(spark, record("x", "pending", None, key="key-a", release="R9"), record("y", "pending", None))
    sent = []

    class Provider:
        def embed(self, rows, text, vector):
            sent.append([r.unit_id for r in rows.collect()])
            return rows.withColumn(vector, F.array(F.lit(1.0), F.lit(2.0)))

    got = {r.unit_id: (r.embedding_status, list(r.vector), r.release_label) for r in embedding.embed(asked, Provider(), embedding.usable(held)).collect()}
    assert got == {"x": ("cached", [0.1, 0.2], "R9"), "y": ("embedded", [1.0, 2.0], "R1")} and sent == [["y"]]
    m = embedding.metrics(embedding.embed(asked, Provider(), embedding.usable(held))).first()
    assert (m.total_records, m.cached_count, m.embedded_count, m.cache_miss_count, m.cache_hit_rate) == (2, 1, 1, 1, 0.5)
    assert embedding.metrics(asked.where("false")).first().cache_hit_rate == 0.0


def test_client_provider(spark):
    asked = records(spark, record("a", "pending", None, text="aa"), record("b", "pending", None, text="b"))
    ok = embedding.ClientProvider(lambda: lambda texts: [[float(len(t))] for t in texts])
    assert {r.unit_id: list(r.vector) for r in embedding.embed(asked, ok).collect()} == {"a": [2.0], "b": [1.0]}
    short = embedding.ClientProvider(lambda: lambda texts: [])
    with pytest.raises(Exception, match="count mismatch"):
        embedding.embed(asked, short).collect()
    with pytest.raises(Exception, match="must not be empty"):
        embedding.embed_query(spark.createDataFrame([("q", "  ")], "query_id string, query string"), embedding.HashProvider()).collect()


def test_limits(spark):
    rows = records(spark, record("a"), record("b", kind="table"))
    for bad in (lambda: embedding.first_units(rows, 0), lambda: embedding.of_kind(rows, "image"), lambda: search.search(rows, [1.0], 0), lambda: search.search(rows, [])):
        with pytest.raises(ValueError):
            bad()
    assert [r.unit_id for r in embedding.of_kind(rows, "table").collect()] == ["b"]


def test_collection(spark, tmp_path):
    c = index.Collection(spark, str(tmp_path), size=2)
    with pytest.raises(RuntimeError, match="does not exist"):
        c.read()
    c.ensure()
    assert c.info().first().points_count == 0
    done = c.upsert(records(spark, record("a"), record("b", vector=None, status="pending"))).first()
    assert (done.attempted_records, done.upserted_points, done.skipped_records) == (2, 1, 1)
    assert [round(x, 4) for x in c.read().first().unit_vector] == [0.4472, 0.8944]
    c.upsert(records(spark, record("z", key="key-a", release="R2"), record("t", kind="table", vector=(1, 0))))
    assert sorted(r.payload.unit_id for r in c.read().collect()) == ["t", "z"]
    assert [r.payload.unit_id for r in c.read(source_kind="table").collect()] == ["t"]
    assert c.sample().columns == ["point_id", "payload"]
    with pytest.raises(Exception, match="has no vector"):
        index.points(records(spark, record("b", vector=None))).collect()


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_steps(spark, tmp_path):
    c = index.Collection(spark, str(tmp_path), size=2, buckets=4)
    c.upsert(records(spark, record("a")))
    old = c.read()
    c.upsert(records(spark, record("b")))
    # a reader of the state before is not disturbed
    assert {r.payload.unit_id for r in old.collect()} == {"a"} and {r.payload.unit_id for r in c.read().collect()} == {"a", "b"}
    # a write that stops halfway is not current, and nothing is emptied after it
    (tmp_path / c.name / f"step-{99:012d}-delta" / "_bucket=1").mkdir(parents=True)
    c.ensure()
    assert c.read().count() == 2
    c.upsert(records(spark, record("d")))
    assert c.version() > 99 and c.read().count() == 3
    before = c.steps(complete=False)
    gone = c.vacuum(keep=1)
    assert 99 in gone and set(c.steps()) == set(before) - set(gone) and c.read().count() == 3
    with pytest.raises(ValueError):
        c.vacuum(0)
    with pytest.raises(ValueError):
        index.Collection(spark, str(tmp_path), buckets=0)


def test_upsert_writes_only_what_changes(spark, tmp_path):
    def made(ids, text):
        n = F.col("id").cast("string")
        return spark.range(*ids).select(
            F.concat(F.lit("u"), n).alias("unit_id"), F.lit(0).alias("unit_index"), F.lit("table").alias("source_kind"), F.lit("FS_A").alias("document_family"), F.concat(F.lit("R"), F.col("id") % 7).alias("release_label"),
            F.lit("h").alias("content_hash"), F.lit("v1").alias("artifact_version"), F.concat(F.lit("key-"), n).alias("cache_key"), F.concat(F.lit(text), F.sha2(n, 512)).alias("text"), F.lit("m").alias("embedding_model"),
            F.lit("embedded").alias("embedding_status"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.hash("id", i).cast("double")).alias("vector"),
        )

    c = index.Collection(spark, str(tmp_path), size=32, buckets=8, compact_at=None)
    c.upsert(made((0, 20_000), "old "))
    whole = _bytes(tmp_path)
    c.upsert(made((19_900, 20_100), "new "))
    assert _bytes(tmp_path) - whole < 0.03 * whole
    assert c.read().count() == 20_100
    assert {r[0]: r[1] for r in c.read().groupBy(F.substring("payload.text", 1, 3)).count().collect()} == {"old": 19_900, "new": 200}
    assert c.read(release_label="R3").count() == sum(i % 7 == 3 for i in range(20_100)) and c.read(upto=c.version() - 1).count() == 20_000
    # only buckets whose deltas are large are written anew
    assert c.layout()[0] == (2, [3]) and c.compact() == list(range(8)) and c.layout()[0] == (4, [])
    c.upsert(made((0, 5), "newer "))
    told = sorted((r.point_id, r.payload.text) for r in c.read().collect())
    before = _bytes(tmp_path)
    touched = {b for b, (_, after) in c.layout().items() if after}
    assert c.compact(share=10.0) == [] and set(c.compact()) == touched and len(touched) <= 5
    assert _bytes(tmp_path) - before < (len(touched) + 1) / 8 * whole
    assert sorted((r.point_id, r.payload.text) for r in c.read().collect()) == told
    c.vacuum(keep=1)
    assert sorted((r.point_id, r.payload.text) for r in c.read().collect()) == told


def test_many_small_upserts_are_compacted(spark, tmp_path):
    c = index.Collection(spark, str(tmp_path), size=2, buckets=1, compact_at=100.0)
    c.upsert(records(spark, record("a")))
    for i in range(index.DELTAS + 2):
        c.upsert(records(spark, record(f"a{i}", key="key-a", vector=(i + 1, 1))))
    (full, after), = c.layout().values()
    assert full > 2 and len(after) < index.DELTAS
    (only,) = c.read().collect()
    assert only.payload.unit_id == f"a{index.DELTAS + 1}"


def test_a_failed_upsert_leaves_readers_whole(spark, tmp_path):
    c = index.Collection(spark, str(tmp_path), size=2)
    c.upsert(records(spark, record("a"), record("b")))
    fails = records(spark, record("a", vector=(9, 9))).withColumn("vector", F.when(F.col("unit_id") == "a", F.raise_error(F.lit("lost")).cast("array<double>")))
    with pytest.raises(Exception, match="lost"):
        c._write(index.points(fails), index.DELTA)
    assert sorted(tuple(r.vector) for r in c.read().collect()) == [(0.1, 0.2)] * 2
    c.upsert(records(spark, record("a", vector=(3, 4))))
    assert sorted(tuple(r.vector) for r in c.read().collect()) == [(0.1, 0.2), (3.0, 4.0)]


def test_cells_of_a_collection(spark, tmp_path):
    c = index.Collection(spark, str(tmp_path), size=2)
    c.upsert(records(spark, *[record(f"u{i}", vector=(i + 1, 20 - i)) for i in range(20)]))
    assert c.cells() is None
    c.build_cells(3)
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, query_vector array<double>")
    rows = lambda df: [(r["rank"], r.point_id, r.score) for r in df.orderBy("rank").collect()]
    assert rows(c.cells().search_many(asked)) == rows(search.search_many(c.read(), asked))
    c.upsert(records(spark, record("new")))
    assert c.cells() is None


def test_memory_collection(spark):
    c = index.MemoryCollection(spark, size=2)
    with pytest.raises(RuntimeError, match="does not exist"):
        c.read()
    assert c.upsert(records(spark, record("a"), record("t", kind="table"), record("n", vector=None))).first().upserted_points == 2
    c.upsert(records(spark, record("z", key="key-a", release="R2")))
    assert {r.payload.unit_id for r in c.read().collect()} == {"t", "z"} and c.read(source_kind="table").count() == 1 and c.info().first().points_count == 2


def test_one_pass(spark):
    """Neither embedding through a cache nor the summary reads its records twice."""
    rows = records(spark, record("a", "pending", None))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    scans = plan(rows).count("LogicalRDD") + plan(rows).count("LocalRelation")
    cache = embedding.last_wins(records(spark, record("b")), ["unit_index"])
    made = plan(embedding.embed(rows, embedding.HashProvider(), cache))
    assert made.count("LogicalRDD") + made.count("LocalRelation") == 2 * scans
    told = plan(embedding.run_summary(rows.withColumn("document_name", F.lit("d"))))
    assert told.count("LogicalRDD") + told.count("LocalRelation") == scans


@pytest.mark.parametrize("how", [{}, {"block_bytes": 200}, {"few": True}])
def test_search_many_against_all_pairs(spark, how):
    rng = np.random.default_rng(3)
    vectors = [tuple(rng.integers(-2, 3, 3).tolist()) for _ in range(60)]
    pts = index.points(records(spark, *[record(f"u{i}", vector=v, release=f"R{i % 3}") for i, v in enumerate(vectors)]), strict=False)
    asked = [(q, [float(x) for x in rng.integers(-2, 3, 3)], None if q % 2 else f"R{q % 3}") for q in range(12)]
    df = spark.createDataFrame(asked, "query_id long, query_vector array<double>, release_label string")
    got = {}
    for r in search.search_many(pts, df, 4, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id, r.score))
    held = pts.collect()
    for q, v, release in asked:
        if not any(v):
            assert q not in got
            continue
        u = np.array(v) / np.linalg.norm(v)
        every = sorted((-round(float(np.dot(u, p.unit_vector)), 12) + 0.0, p.point_id) for p in held if p.unit_vector and release in (None, p.payload.release_label))[:4]
        assert [(p, round(s, 9)) for _, p, s in sorted(got[q])] == [(p, round(-s, 9)) for s, p in every]


def test_search_many_leaves_queries_on_the_executors(spark):
    """The plan is the same for 3 and 3,000 queries, and holds no vector."""
    pts = index.points(records(spark, *[record(f"u{i}", vector=(i, 1)) for i in range(9)]))
    plans = []
    for n in (3, 3000):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.array((F.col("id") + 1).cast("double"), F.lit(2.0)).alias("query_vector"))
        out = search.search_many(pts, asked, 2)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        assert out.count() == 2 * n
    assert plans[0].count("\n") == plans[1].count("\n") and plans[0].count("FlatMapCoGroupsInArrow") == 1


def test_search_many_filters_before_it_moves(spark):
    pts = index.points(records(spark, record("a", release="R1"), record("b", release="R2")))
    asked = spark.createDataFrame([("q", [1.0, 2.0], "R2")], "query_id string, query_vector array<double>, release_label string")
    out = search.search_many(pts, asked, 5)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString() and [r.payload.unit_id for r in out.collect()] == ["b"]


def test_search_without_queries_or_points(spark):
    pts = index.points(records(spark, record("a")))
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, query_vector array<double>")
    for few in (False, True):
        assert search.search_many(pts.limit(0), asked, few=few).count() == 0
        assert search.search_many(pts, asked.limit(0), few=few).count() == 0
        assert search.search_many(pts, asked.withColumn("query_vector", F.array(F.lit(1.0))), few=few).count() == 0


def test_search(spark):
    pts = index.points(records(spark, record("close", vector=(1, 0)), record("far", vector=(0, 1)), record("zero", vector=(0, 0)), record("r2", vector=(1, 0), release="R2", kind="table")))
    top = search.search(pts, [2.0, 0.0], 1, release_label="R1").first()
    assert top.payload.unit_id == "close" and top.score > 0.99
    assert [r.payload.unit_id for r in search.search(pts, [1.0, 0.0], document_family="FS_A", release_label="R2", source_kind="table").collect()] == ["r2"]
    plan = search.search(pts, [1.0, 0.0], 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    asked = spark.createDataFrame([("q1", [1.0, 0.0], "R2"), ("q2", [0.0, 1.0], None)], "query_id string, query_vector array<double>, release_label string")
    got = {(r.query_id, r["rank"]): r.payload.unit_id for r in search.search_many(pts, asked, 1).collect()}
    assert got == {("q1", 1): "r2", ("q2", 1): "far"}


def hits(spark, *rows):
    """rows: (query, rank, score, unit, release, kind, text)"""
    payload = lambda u, r, k, t: tuple({"unit_id": u, "release_label": r, "source_kind": k, "text": t, "document_family": "FS_A"}.get(c) for c in PAYLOAD)
    kinds = ",".join(f"{c}:{'int' if c == 'unit_index' else 'string'}" for c in PAYLOAD)
    return spark.createDataFrame([(q, n, f"p{n}", s, payload(u, r, k, t)) for q, n, s, u, r, k, t in rows], f"query_id string, rank int, point_id string, score double, payload struct<{kinds}>")


def test_sufficiency(spark):
    found = hits(spark, ("ok", 1, 0.75, "u", "R1", "table", "alpha"), ("ok", 2, 0.5, "v", "R1", "table", "beta"), ("low", 1, 0.2, "u", "R1", "table", "x"), ("edge", 1, 0.3, "u", "R1", "table", "x"))
    asked = spark.createDataFrame([("ok",), ("low",), ("none",), ("edge",)], "query_id string")
    got = {r.query_id: (r.is_sufficient, r.reason) for r in evidence.assess(asked, found).collect()}
    assert got["ok"][0] and got["edge"][0] and got["low"] == (False, "Top score 0.2 is below required threshold 0.3.")
    assert got["none"] == (False, "Expected at least 1 results, got 0.")
    marked = {r.query_id: r.is_sufficient for r in evidence.assess(asked, found, markers=["alpha\nbeta"]).collect()}
    assert marked == {"ok": True, "low": False, "none": False, "edge": False}
    for bad in ({"min_results": 0}, {"min_top_score": -1.0}):
        with pytest.raises(ValueError):
            evidence.assess(asked, found, **bad)


def test_answers(spark):
    found = hits(spark, ("good", 1, 0.9, "u1", "R1", "table", "evidence text"), ("bad", 1, 0.9, "u1", "R1", "table", "evidence text"))
    asked = spark.createDataFrame([("good", "What?"), ("bad", "Which?"), ("none", "Why?")], "query_id string, query string")
    calls = spark.sparkContext.accumulator(0)

    def connect():
        def client(system, user):
            calls.add(1)
            return (" See [C99] " if "Which?" in user else " It is so [C1]. ", 2000, 500)

        return client

    got = {r.query_id: r for r in answer.grounded_answers(asked, found, answer.ChatClient(connect, "m")).collect()}
    assert got["good"].answer == "It is so [C1]." and got["good"].is_answered and got["good"].usage.total_tokens == 2500
    assert not got["bad"].is_answered and got["bad"].refusal_reason.startswith("Citation validation failed") and got["bad"].usage.prompt_tokens == 2000
    assert got["none"].answer == answer.REFUSAL and got["none"].usage is None and calls.value == 2
    blank = answer.ChatClient(lambda: lambda s, u: ("  ", 1, 1))
    with pytest.raises(Exception, match="content was empty"):
        answer.grounded_answers(asked, found, blank).collect()


def test_evaluation(spark):
    found = hits(spark, ("a", 1, 0.9, "u", "R1", "table", "limit"), ("a", 2, 0.8, "v", "R2", "paragraph", "other")).withColumnRenamed("query_id", "case_id")
    schema = "case_id string, expectation struct<expected_to_pass:boolean,min_results:int,expected_release_label:string,expected_source_kind:string,expected_top1_contains_any:array<string>,expected_text_contains_any:array<string>>"
    cases = spark.createDataFrame([("a", (True, 3, "R1", "table", ["zz"], ["limit", "it's"])), ("b", (False, 1, None, None, ["x"], []))], schema)
    done = evaluation.evaluated(cases, found)
    got = {r.case_id: r for r in done.collect()}
    assert got["a"].failures == [
        "Expected at least 3 results, got 2", "Found results with unexpected release_label values: ['R2']", "Found results with unexpected source_kind values: ['paragraph']",
        "Top-1 result did not contain expected text markers: ['zz']",
    ]
    assert got["b"].failures == ["Expected at least 1 results, got 0", "Top-1 expectation could not be checked because no results were returned."] and got["b"].outcome_as_expected
    assert evaluation.report(done).first().asDict() == {"total_cases": 2, "passed_count": 0, "expected_outcome_count": 1}
