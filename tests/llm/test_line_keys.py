import numpy as np
import pyarrow as pa
from stratalens.llm import line_dedup as L
from stratalens.llm import words as W


def postings(rows, seed=0):
    rng = np.random.default_rng(seed)
    col = {c: rng.integers(0, 100, rows).astype(t) for c, t in L._POSTED.items()}
    col["k"][:] = 0
    for c in ("c", "bits"):
        col[c] = rng.integers(0, 1 << 63, rows).astype(np.uint64)
    return col


def same(a, b):
    return all(a[c].dtype == b[c].dtype and (a[c] == b[c]).all() for c in a)


def test_postings_take_the_bytes_they_need():
    col = postings(1000)
    blob = L._packed(col, L._POSTED)
    # class and bitmap are hashes of 8 bytes, four columns have a byte each, the row's name none
    assert len(blob) < 1000 * 22
    assert same(col, L._unpacked(blob, L._POSTED))


def test_packed_runs_of_far_values():
    col = postings(64)
    col["o"][:8] = [2**63 - 1, -(2**63), -1, 0, 5, 300, 70_000, -300]
    col["k"][3], col["list"][5], col["c"][:2], col["line"][7] = -7, 2**64 - 1, (0, 2**64 - 1), 2**31 - 1
    for c in ("c", "list"):
        col[c] = col[c].astype(np.uint64)
    first = np.array([0, 1, 5, 6, 40])
    for a, z, blob in zip(first, np.append(first[1:], 64), L._packs(col, L._POSTED, first), strict=True):
        assert same({c: v[a:z] for c, v in col.items()}, L._unpacked(blob, L._POSTED))


def test_postings_dealt_by_list_and_partition():
    col = postings(500)
    part = (col["list"] * np.uint64(7) % np.uint64(5)).astype(np.int64)
    got = {x: L._unpacked(blob, L._POSTED) for x, blob in L._dealt(col, part)}
    assert sorted(got) == sorted(set(part.tolist()))
    rows = lambda c: sorted(zip(*[v.tolist() for v in c.values()]))
    for x, own in got.items():
        assert rows(own) == rows({c: v[part == x] for c, v in col.items()})
    assert not list(L._dealt({c: v[:0] for c, v in col.items()}, part[:0]))


def test_order_by_keys_is_the_full_order():
    rng = np.random.default_rng(2)
    o, line = rng.integers(-50, 50, 3000), rng.integers(0, 9, 3000).astype(np.int32)
    for far in (0, 2**63 - 60):  # the second has no room in a key
        o[0] = far
        assert (L._order(o, line)[0] == np.lexsort((line, o))).all()
    # hashes that differ in their last bits only, beside a far one
    h = np.append(rng.integers(0, 4, 3000).astype(np.uint64), np.uint64(2**64 - 1))
    assert (h[L._exact(h)] == np.sort(h)).all()
    assert len(L._order(h[:0])[0]) == 0 and L._order(h[:1])[0].tolist() == [0]


def test_lists_that_share_their_first_bits_stay_apart():
    # two lists of two lines each; the far list leaves the key no room for the bits that tell them apart
    rows = 2001
    col = {c: np.zeros(rows, t) for c, t in L._POSTED.items()}
    col["o"][:], col["c"][:], col["n"][:], col["list"][-1] = np.arange(rows), np.arange(rows), 10, 2**64 - 1
    col["list"][:-1] = np.arange(rows - 1) % 1000
    pairs = {(r["yo"], r["xo"]) for b in L._compared(col) for r in b.to_pylist() if r["kind"] == L.PAIR}
    assert pairs == {(i + 1000, i) for i in range(1000)}


def test_white_space_is_told_by_value():
    raw = np.arange(256, dtype=np.uint8)
    assert np.flatnonzero(W.spaces(raw)).tolist() == [9, 10, 11, 12, 13, 32]


def test_a_sketch_counts_all_hashes(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("c " * 70_000,)], "text string").repartition(3)
    slots = L.SKETCH[0]
    want = np.zeros(slots, np.int64)
    for text in ("a b a", "c " * 70_000):
        for _, raw, starts in W.texts(pa.array([text])):
            np.add.at(want, (W.words(raw, starts)[1] & np.uint64(slots - 1)).astype(np.int64), 1)
    assert (L.sketch(df, slots) == want).all()


def test_ids_are_asked_for_repeats_once(spark, monkeypatch):
    asked, own = [], L.row_key
    monkeypatch.setattr(L, "row_key", lambda *a: asked.append(a) or own(*a))
    df = spark.createDataFrame([(1, "é b\nc\n"), (2, "b é"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in L.marked(df).collect()}
    assert got == {1: (3, []), 2: (1, [0]), 3: (0, []), 4: (1, [])} and len(asked) == 1
    assert sorted(r.doc_id for r in L.deduplicated(df).collect()) == [1, 3, 4] and len(asked) == 2
