import numpy as np
import pyarrow as pa
from stratalens.llm import line_dedup as L
from stratalens.llm import words as W


def test_a_class_never_meets_itself():
    one = np.array([7, 7, 9], np.uint64)
    rows = {"list": one * 0, "o": np.arange(3), "k": one * 0, "line": one * 0, "c": one, "n": one * 0 + 10, "bits": one * 0, "at": one * 0}
    col = {c: rows[c].astype(t) for c, t in L._POSTED.items()}
    out = {(r["kind"], r["yo"], r["xo"]) for b in L._compared(col) for r in b.to_pylist() if r["kind"] in (L.SAME, L.PAIR)}
    bits_differ = {**col, "bits": np.array([0, 1, 0], np.uint64)}
    assert out == {(L.SAME, 1, 0), (L.PAIR, 2, 0)}
    assert not any(r["kind"] == L.SAME for b in L._compared(bits_differ) for r in b.to_pylist())


def test_words_in_pieces(monkeypatch):
    texts = ["a bb  ccc\n\nbb", "", "\n", "x" * 700 + " y\n" + "z" * 300, "é \x0b\x1c u\u2003v"]
    whole = _sets(texts)
    monkeypatch.setattr(W, "SLICE", 5)
    W._powers.clear()
    assert _sets(texts) == whole
    for d, text in enumerate(texts):
        for i, line in enumerate(text.encode().split(b"\n")):
            assert len(whole.get((d, i), ())) == len(set(line.split()))


def _sets(texts):
    out = {}
    for at, raw, starts in W.texts(pa.array(texts)):
        h, line, place = L._words(raw, starts)
        if len(h):
            h, begin, n = L._distinct(h, line, np.zeros(len(h), np.uint64))
            text, number = L._numbered(raw, starts, place)
            out |= {(int(at + t), int(k)): frozenset(h[b : b + m].tolist()) for t, k, b, m in zip(text, number, begin, n)}
    return out


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    col = {c: rng.integers(0, 1 << 30, 50).astype(t) for c, t in L._POSTED.items()}
    back = L._unpacked(L._packed(col, L._POSTED), L._POSTED)
    assert all((back[c] == col[c]).all() for c in col)


def test_packed_order_is_the_full_order():
    rng = np.random.default_rng(1)
    line = np.sort(rng.integers(0, 50, 5000))
    h = rng.integers(0, 300, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rank = (h >> np.uint64(60)).astype(np.uint64)
    for k in (h, h & np.uint64(0xFFFFFF)):  # the second has ties in the packed key
        order = L._ordered(k, rank, line)
        want = np.lexsort((k, rank, line))
        assert (line[order] == line[want]).all() and (k[order] == k[want]).all()
