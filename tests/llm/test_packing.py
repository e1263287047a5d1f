import random
import re
from collections import Counter, defaultdict

from brute import SF
from stratalens.llm import packing as P
from stratalens.llm.queries import op5_best_fit_packing


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_best_fit(items, capacity, per_source):
    """Bins by looking at every open bin for each piece."""
    bins = []
    out = []
    for size, cluster, source in items:
        ok = [i for i, b in enumerate(bins) if b[0] >= size and cluster not in b[1] and b[2][source] < per_source]
        i = min(ok, key=lambda i: (bins[i][0], i), default=len(bins))
        if i == len(bins):
            bins.append([capacity, set(), Counter()])
        bins[i][0] -= size
        bins[i][1].add(cluster)
        bins[i][2][source] += 1
        out.append(i)
    return out


def test_bins_against_a_full_search():
    rng = random.Random(5)
    for per_source in (1, 2, 4):
        items = [(rng.choice((0, 1, 5, rng.randint(0, 60))), rng.randint(0, 30) if rng.random() < 0.5 else 1, rng.choice("aab")) for _ in range(700)]
        bins = P.Bins(60, per_source)
        assert [bins.place(*x) for x in items] == plain_best_fit(items, 60, per_source)


def check(got, docs, capacity, per_source):
    """docs: (doc_id, text, source) of every row."""
    whole = Counter()
    bins = defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.words
        bins[r.bin].append(r)
    want = Counter()
    for d, t, _ in docs:
        want[d] += len(words(t))
    assert whole == want
    source = {d: s for d, _, s in docs}
    text = {d: " ".join(words(t)).lower() for d, t, _ in docs}
    for b in bins.values():
        assert sum(r.words for r in b) + b[0].residual == capacity
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert max(Counter(text[r.doc_id] for r in b).values()) == 1
        assert max(Counter(source[r.doc_id] for r in b).values()) <= per_source
    return bins


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", None), (3, "x " * 5000, "b"), (4, "One  two", "b"), (5, "one two", "c"), (4, "One  two", "b"), (6, "w " * 2048, None), (6, "w " * 2048, None), (None, "n", "a"), (2**62 + 1, "m", "a")]
    docs += [(10 + i, "v " * (i % 90), "hot") for i in range(400)]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, source string, bin string, words int")
    check(P.pack(df).collect(), docs, P.CAPACITY, P.PER_SOURCE)
    check(P.pack(df, 100, 2, 50).collect(), docs, 100, 2)
    assert P.digest(df.where("false")).count() == 0


def test_assembled(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s"), (2, "f", "s"), (3, None, "s")], "doc_id long, text string, source string")
    got = {r.bin: r.text for r in P.assembled(P.pack(docs, 3), docs).collect()}
    assert sorted(sum((words(t) for t in got.values()), [])) == list("abcdef") and any("a b c" in t for t in got.values())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op5_best_fit_packing(spark, SF).collect()
    bins = check(got, docs, P.CAPACITY, P.PER_SOURCE)
    total = sum(len(words(t)) for _, t, _ in docs)
    assert len(bins) <= 1.1 * total / P.CAPACITY + 3
    assert sorted(got) == sorted(op5_best_fit_packing(spark, SF).collect())


def test_near_copies_do_not_share_a_bin(spark, tmp_path):
    rng = random.Random(6)
    docs, group = [], {}
    for k in range(30):
        base = [f"W{rng.randrange(10**6)}" for _ in range(100)]
        for copy in range(3):
            w = list(base)
            if copy:
                w[rng.randrange(100)] = "É" if copy == 1 else "é"
            group[len(docs)] = k
            docs.append((len(docs), " ".join(w), f"s{len(docs) % 7}"))
    docs += [(90, None, "a"), (91, " ", "b"), (92, "É x", "a"), (93, "é  X", "b")]
    group |= {90: "none", 91: "none", 92: "e", 93: "e"}
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_best_fit_packing(spark, str(tmp_path)).collect()
    bins = check(got, docs, P.CAPACITY, P.PER_SOURCE)
    assert all(max(Counter(group[r.doc_id] for r in b).values()) == 1 for b in bins.values())


def test_a_row_of_many_copies_is_spread(spark):
    docs = [(5, "a b c", "hot")] * 3000 + [(100 + i, "w " * (i % 50), "s") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = P.pack(df, 60, 4, 300).collect()
    check(got, docs, 60, 4)
    assert max(Counter(r.bin.split("-")[0] for r in got).values()) < 600


def test_long_documents_leave_shards_small(spark):
    docs = [(i, "w " * (41 * 100 + i % 7), f"s{i % 3}") for i in range(300)] + [(7, "w " * 4100, "s1")] * 3
    got = P.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), 100, 4, 50).collect()
    check(got, docs, 100, 4)
    sizes = Counter(r.bin.split("-")[0] for r in got)
    full = sizes.pop("full")
    assert full == 41 * 303 and max(sizes.values()) <= 2 * 50
