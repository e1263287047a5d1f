import random
import re

import numpy as np
import xxhash
from brute import SF
from stratalens.llm import simhash as S
from stratalens.llm.queries import op1_simhash_near_dedup


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """fps: list of (id, fp); the component of each fingerprint."""
    u = sorted({f for _, f in fps})
    root = {f: f for f in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for d, f in fps:
        if d is not None:
            r = find(f)
            least[r] = min(least.get(r, d), d)
    return {f: least.get(find(f)) for f in u}


def test_keys_meet_every_pair_within_three_bits():
    rng, code = np.random.default_rng(1), S.Golay()
    a = rng.integers(0, 2**63, 4000, dtype=np.int64).view(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    stored, sought = set(zip(*map(np.ndarray.tolist, S.stored_keys(a, code)))), [set() for _ in a]
    for r, k in zip(*map(np.ndarray.tolist, S.sought_keys(b, code))):
        sought[r].add(k)
    held = [set() for _ in a]
    for r, k in stored:
        held[r].add(k)
    assert all(x & y for x, y in zip(held, sought))


def test_odd_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [None, "", "  \n", "One", "one TWO", "ÀB c d e", base, base + " tail", base.replace("word7 ", "w7 "), "x " * 30_000, base, "y" * 100_000]
    ids = [*range(10, 10 + len(texts) - 2), 2**62 + 1, None]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in zip(ids, texts)] * 2, "doc_id long, text string, fp string, component long")
    got = S.digest(docs).collect()
    want = [(i, plain(t)) for i, t in zip(ids, texts)]
    comp = brute(want)
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, fingerprint=f"{f:016x}", component_id=comp[f])) for i, f in want * 2)
    assert S.digest(docs.where("false")).count() == 0


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 5)]
    fps = list({f ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False))) for f in fps for _ in range(120)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.u, r.v) for r in S.links(nodes).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = [(d, plain(t)) for d, t in texts.items()]
    comp = brute(fps)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op1_simhash_near_dedup(spark, SF).collect()}
    assert got == {(d, f"{f:016x}", comp[f]) for d, f in fps}
    assert len({c for _, _, c in got}) < len(got)


def test_representatives(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base + " tail", "b"), (3, base + " tail", "b"), (9, "other words here", "c"), (None, base, "d"), (2, None, "e"), (1, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = S.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 9]
    assert S.representatives(docs.where("false")).count() == 0


def jaccard(a, b):
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in (a, b))]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1]) if grams[0] | grams[1] else 1.0


def test_stage_links_all_similar(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(base)), changed):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    texts += ["", " ", "one two", "one three", "ONE two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    far = [(S.fingerprint(texts[i]) ^ S.fingerprint(texts[j])).bit_count() for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert max(far) > 3
    assert sorted(r.doc_id for r in S.representatives(df).collect()) == sorted(set(parent))


def test_stage_verifies_candidates(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([f"v{i}" for i in range(60)] + base[60:]), " ".join(base + ["tail"])]
    keys = [set(S.band_keys(S.shingles(t)).tolist()) for t in texts]
    assert keys[0] & keys[1] and jaccard(texts[0], texts[1]) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.representatives(df).collect()) == [0, 1]


def similar_groups(texts):
    """The component of each text, by comparing all."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def family(rng, n, shared, changed):
    """Texts of a template: ``shared`` words, then words of their own, of which some are near-copies of an earlier one."""
    base, out = [f"t{i}" for i in range(shared)], []
    for _ in range(n):
        w = base + [f"w{rng.randrange(10**7)}" for _ in range(200 - shared)]
        if out and rng.random() < 0.3:
            w = rng.choice(out).split()
            for at in rng.sample(range(200), rng.choice(changed)):
                w[at] = f"c{rng.randrange(10**7)}"
        out.append(" ".join(w))
    return out


def test_prefix_join_finds_what_brute_force_finds(spark):
    rng = random.Random(8)
    texts = family(rng, 90, 150, (1, 3, 4, 5, 6)) + [" ".join(f"s{i}" for i in range(n)) for n in (5, 6, 7, 8, 9, 30, 36, 37, 38, 45)] + ["one", "one"]
    held = {i: S.shingles(t).view(np.int64).tolist() for i, t in enumerate(texts)}
    have = spark.createDataFrame(list(held.items()), "node long, held array<long>")
    roots = spark.createDataFrame([(i, i) for i in held], "node long, root long")
    want = {(i, j) for j in held for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    for block in (S.BLOCK, 7):
        got = {(r.u, r.v) for r in S.prefix_pairs(have, roots, block=block).collect()}
        assert want <= got and len(got) < len(held) ** 2 / 8
    # pairs of one root are not asked for
    merged = spark.createDataFrame([(i, i % 2) for i in held], "node long, root long")
    got = {(r.u, r.v) for r in S.prefix_pairs(have, merged).collect()}
    assert {(i, j) for i, j in want if (i + j) % 2} <= got and all((i + j) % 2 for i, j in got)


def test_a_template_is_no_join_of_all_pairs(spark):
    rng = random.Random(9)
    texts = family(rng, 600, 140, (60,))
    held = {i: S.shingles(t).view(np.int64).tolist() for i, t in enumerate(texts)}
    have = spark.createDataFrame(list(held.items()), "node long, held array<long>")
    assert S.prefix_pairs(have, spark.createDataFrame([(i, i) for i in held], "node long, root long")).count() < 600


def test_long_keys_are_linked_whole(spark):
    texts = family(random.Random(10), 150, 150, (1, 3, 4, 5, 6))
    keys = [set(S.band_keys(S.shingles(t)).tolist()) for t in texts]
    assert max(sum(k in own for own in keys) for k in keys[0]) > S.LIST
    got = {r.id: r.component for r in S.similar(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), coarse=False).collect()}
    root = similar_groups(texts)
    assert len({got[i] for i in got}) == len(set(root)) == len({(got[i], root[i]) for i in got})
