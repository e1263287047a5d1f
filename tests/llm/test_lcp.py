import hashlib
import random

import numpy as np
from brute import SF
from stratalens.llm import lcp as L
from stratalens.llm.queries import op8_document_fingerprints


M = (1 << 64) - 1


def mixed(x):
    x &= M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_level(names):
    """One level of the parsing of one text, symbol by symbol."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    x = [a if n == 1 else mixed(a + mixed(n)) for a, n in runs]
    bit = lambda d: (d & -d).bit_length() - 1
    label = []
    for i, v in enumerate(x):
        low = bit(v ^ x[i - 1]) if i and v != x[i - 1] else 0
        label.append(2 * low + (v >> low & 1))
    for _ in range(3):
        before = [label[0] ^ 1, *label[:-1]]
        low = [bit(p ^ o) if p != o else 0 for p, o in zip(before, label)]
        label = [2 * k + (o >> k & 1) for k, o in zip(low, label)]
    start = [i for i in range(len(x)) if i == 0 or i < len(x) - 1 and label[i - 1] < label[i] > label[i + 1]]
    return [mixed(sum(mixed(v) * int(L._PLACES[j & 63]) for j, v in enumerate(x[a:z])) + z - a) for a, z in zip(start, [*start[1:], len(x)])]


def plain_sketch(text):
    out = [0xFFFF] * L.BINS
    names = [ord(c) for c in text]
    for level in range(1, 4):
        names = plain_level(names) if names else []
        if level in L.LEVELS:
            for name in names:
                out[name % L.BINS] = min(out[name % L.BINS], min(name >> 48, 0xFFFE))
    return out


def test_against_a_plain_parser(spark):
    rng = random.Random(2)
    made = ["", "a", "aa", "ab", "aaaa bbbb", "é\U0001f600" * 9, "".join(rng.choice("ab") for _ in range(500)), "x" * 300 + "y" * 50 + "xy" * 40]
    texts = made + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert [r.tolist() for r in L.sketches(texts)] == [plain_sketch(t) for t in texts]


def test_an_id_of_many_rows(spark):
    rng = random.Random(7)
    texts = [f"t{i} " + "".join(rng.choice("abc ") for _ in range(60)) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts[:100])] + [(50, t) for t in texts[100:]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = L.in_ranges(df, rows=20).rdd.glom().collect()
    assert max(map(len, parts)) < 100 and len(parts) > 15
    order = [(r.id, r.text) for p in parts for r in p if not r.guest]
    assert [i for i, _ in order] == sorted((i for i, _ in rows), reverse=True) and sorted(order) == sorted(rows)
    after = {a: b for a, b in zip(order, order[1:] + order[:1])}
    got = L.compared(df, rows=20).collect()
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == sorted((a[0], hashlib.sha256(edited(a[1], b[1]).encode()).hexdigest()) for a, b in after.items())


def edited(t, after):
    k = len(t) // 3
    return t[: len(t) - k] + after[:k]


def check(got, docs):
    """docs: (doc_id, text) with unique ids, in the order of comparison."""
    assert len(got) == len(docs)
    texts = {d: t or "" for d, t in docs}
    order = [d for d, _ in docs]
    after = {d: texts[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    prints = {}
    for r in got:
        t, e = texts[r.doc_id], edited(texts[r.doc_id], after[r.doc_id])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = L.sketches([t, e, after[r.doc_id]])
        assert [r.fingerprint, r.edited_fingerprint] == L._hex(np.stack([a, b]))
        assert r.near_edited == L.likeness(a[None], b[None])[0] and r.near_next == L.likeness(a[None], c[None])[0]
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_equal_substrings_share_phrases():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh  ") for _ in range(6000))
    other = "".join(rng.choice("abcdefgh  ") for _ in range(6000))
    a, b, c, d = L.sketches([text, "xyz" * 7 + text, text[:3000] + other[:3000], other])
    near = lambda x, y: L.likeness(x[None], y[None])[0]
    assert near(a, b) > 0.95 and 0.2 < near(a, c) < 0.5 and near(a, d) < 0.1


def test_labels_differ_and_are_few():
    x = np.array([1, 2, 1, 5, 2**63, 7, 2**40, 2**40 + 1] * 50, np.uint64)
    first = np.array([0, 8, 100])
    label = L._labels(x, first)
    assert label.max() < 6
    inner = np.setdiff1d(np.arange(1, len(x)), first)
    assert (label[inner] != label[inner - 1]).all()


def test_slices_do_not_matter(monkeypatch):
    texts = ["", "a", "ab" * 500, "é" * 300, "The cat sat on the mat. " * 40, "\n"] * 3
    whole = L.sketches(texts)
    monkeypatch.setattr(L, "SLICE", 10)
    assert (L.sketches(texts) == whole).all()


def test_odd_rows(spark):
    texts = [None, "", "a", "ab", "abc", "aaaa" * 9000, "the cat sat on the mat " * 3000, "é\U0001f600x" * 50, "one", "one"]
    docs = [(7 * i - 20, t) for i, t in enumerate(texts)] + [(2**62 + 1, "big id " * 9)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    for rows in (1024, 3, 1):
        check(L.compared(df, rows=rows).collect(), sorted(docs, reverse=True))
    assert L.digest(df.where("false")).count() == 0 and L.digest(df.where("false")).columns == L.digest(df).columns
    one = L.digest(df.where("doc_id = -6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_null_and_repeated_ids(spark):
    rows = [(None, "null a"), (None, "null b"), (5, "five"), (5, "five"), (6, "six")]
    got = L.compared(spark.createDataFrame(rows, "doc_id long, text string"), rows=2).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in rows)


def test_whole_table(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = op8_document_fingerprints(spark, SF).collect()
    check(got, docs)
    far = [r for r in got if r.near_next < 0.2 and r.n_chars > 300]
    assert far and sum(r.near_edited for r in far) / len(far) > 0.4
