import random

from brute import SF
from stratalens.llm import line_dedup as L
from stratalens.llm.queries import op6_line_dedup


def brute(docs):
    """docs: (id, text) rows, each an occurrence of its own.  The removed line numbers of each place."""
    order = sorted((i for i, d in enumerate(docs) if d[1] is not None), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, docs[i][1]))
    before, out = [], {}
    for place in order:
        row = docs[place]
        for i, line in enumerate(row[1].split("\n")):
            w = frozenset(line.encode().split())
            if w:
                if any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in before):
                    out.setdefault(place, []).append(i)
                before.append(w)
    return out


def check(got, docs):
    want = brute(docs)
    expect = sorted(str((d, 0 if t is None else len(t.split("\n")), want.get(i, []))) for i, (d, t) in enumerate(docs))
    assert sorted(str((r.doc_id, r.n_lines, list(r.removed))) for r in got) == expect


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.sample(vocab, rng.randint(1, 40)) for _ in range(25)]
    docs = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rng.shuffle(w)
            lines.append(rng.choice((" ", "  ")).join(w))
        docs.append((d, "\n".join(lines)))
    return docs


def test_against_brute_force(spark):
    docs = made(1, 250)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(L.marked(df).collect(), docs)
    check(L.marked(df, hot=20).collect(), docs)


def test_a_dense_group(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(30)]
    docs = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(30)] = f"v{rng.randrange(60)}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(L.marked(df).collect(), docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "a b\nb a\n \na"), (5, "é è\né è\n"), (None, "a b"), (6, "x " * 40_000), (7, "x"), (8, " ".join(f"q{i}" for i in range(20_000))), (9, "\n".join(["same line"] * 500)), (9, "other text")]
    rows = docs + [(4, "a b\nb a\n \na")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, removed string, n int")
    check(L.marked(df).collect(), rows)
    assert L.digest(df.where("false")).count() == 0
    out = L.deduplicated(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {(1, None), (2, ""), (3, "\n\n"), (4, "a b\n \na"), (5, "é è\n"), (6, "x " * 40_000), (8, docs[8][1]), (9, "same line"), (9, "other text")}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    got = op6_line_dedup(spark, SF).collect()
    assert {r.doc_id: r.removed for r in got if r.n_removed} == {d: ",".join(map(str, v)) for d, v in ((docs[i][0], v) for i, v in want.items())}


def test_rows_that_repeat_lose_their_lines(spark, monkeypatch):
    monkeypatch.setattr(L, "COPIES", 3)
    monkeypatch.setattr(L, "SHARE", 16)
    docs = [(1, "one two three\n\nfour")] * 9 + [(None, "a b")] * 3 + [(2, "one two three"), (3, None), (3, None), (4, " \n"), (4, " \n"), (5, "x"), (5, "y")]
    df = spark.createDataFrame([(*d, i % 2) for i, d in enumerate(docs)], "doc_id long, text string, n int")
    check(L.marked(df).collect(), docs)
    out = [(r.doc_id, r.text) for r in L.deduplicated(df).collect()]
    key = lambda d: (d[0] or 0, d[1] or "")
    assert sorted(out, key=key) == sorted([docs[0], (None, "a b"), (3, None), (3, None), (4, " \n"), (4, " \n"), (5, "x"), (5, "y")], key=key)
