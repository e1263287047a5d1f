from brute import SF, digest, joined, private
from stratalens.llm import pii as P
from stratalens.llm.queries import op10_private_data

ODD = [
    None, "", "a.b+c@d-e.f.g@h.i", "a@b.c+d@e.f x@y", "@" * 3000, "a" * 60_000, "1.2.3.4.5 999.1.1.1 007.0.0.0255 1.2.3.00000000255", "+1 (555) 123-4567 +12 +123456789012345678 +1",
    "4539 1488 0343 6467 4539148803436467 4539-1488-0343-6468 12", "9" * 40_000, "1-" * 30_000, "é 4539148803436467é a@b.cé", "+1.2.3.4.5.6.7.8.9.0", "1.1.1.1" + "0" * 50_000,
    "0000 0000 0000", "a@b" + ".c" * 20_000 + ".", "a@b..c @b.c a@-.-", " ".join(f"u{i}@h.com" for i in range(1300)),
]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = private(texts[r.doc_id])
        kinds = [s[2] for s in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone")), (r, want[:3])
        assert r.base_sha256 == digest(want)
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, base string")
    check(P.digest(docs).collect(), dict(enumerate(ODD)))
    assert P.digest(docs.where("false")).count() == 0


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_private_data(spark, SF).collect()
    check(got, texts)
    added = sum(len(r.spans.split(",")) for r in got if r.spans) - sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    assert added == 0  # the table holds no personal data of the added kinds


def test_held_out_sentences(spark):
    made = P.sentences(400, 99)
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: {(s.start, s.end) for s in r.base + r.added} for r in P.find(docs).collect()}
    hits = sum((a, b) in got[i] for i, (_, a, b, y) in enumerate(made) if y)
    wrong = sum((a, b) in got[i] for i, (_, a, b, y) in enumerate(made) if not y)
    assert hits >= 0.9 * sum(y for *_, y in made)
    assert wrong <= 0.05 * sum(1 - y for *_, y in made)


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now"), (2, None), (3, "éé +1 (555) 123-4567"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.redacted(docs).collect()}
    assert got == {1: "mail [email] now", 2: None, 3: "éé [phone]", 4: ""}
