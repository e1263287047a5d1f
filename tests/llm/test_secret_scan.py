from brute import SF, digest, joined, secrets
from stratalens.llm import secret_scan as S
from stratalens.llm.queries import op4_secret_scan

ODD = [
    None, "", "x" * 50_000, "token:token:abcdef1", "Api_Key = 'abcdef' PASSWORD=secret=abcdef", "é AKIA" + "A" * 16 + " AKIAshort",
    "deadbeef" * 4 + "é" + "0123456789abcdef" * 2, "secret: abc", "token=" + "a" * 30, "ſecret=abcdefgh", " ".join(f"token={i:08d}" for i in range(1500)),
]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = secrets(texts[r.doc_id])
        kinds = [s[2] for s in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex")), r.doc_id
        assert r.base_sha256 == digest(want)
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, blob string")
    check(S.secret_digest(docs).collect(), dict(enumerate(ODD)))
    assert S.secret_digest(docs.where("false")).count() == 0


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op4_secret_scan(spark, SF).collect(), texts)


def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(1, "token=abcdefg"), (2, "token=abcdefg"), (3, "plain")], "doc_id long, text string")
    one = S.update_ledger(docs)
    assert one.count() == 2
    # a finding that no scan would make shows that a seen pair is not scanned again
    planted = one.withColumn("spans", S.F.expr("array(named_struct('start', 0, 'rank', 0, 'kind', 'planted', 'end', 1))"))
    more = docs.union(spark.createDataFrame([(4, "secret=hijklmn"), (None, None)], "doc_id long, text string"))
    two = S.update_ledger(more, planted)
    got = {r.doc_id: [s.kind for s in r.spans] for r in S.findings(more, two).collect()}
    assert got == {1: ["planted"], 2: ["planted"], 3: ["planted"], 4: ["assign"], None: []}
    newer = tuple(S.Rule(r.kind, r.pattern, r.least, r.group, r.needs, 2) if r.kind == "assign" else r for r in S.RULES)
    three = S.update_ledger(docs, one, newer)
    got = {r.doc_id: [s.kind for s in r.spans] for r in S.findings(docs, three).collect()}
    assert got == {1: ["assign"], 2: ["assign"], 3: []}
