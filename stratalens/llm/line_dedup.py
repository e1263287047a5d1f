"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  The words of a line are put in order of rarity: a sketch of counters
over all lines' words, whose size follows the input, gives each word's frequency class, and a hash breaks
ties (any order is right, rare words first is fast).  Sets of Jaccard similarity ``LEAST`` or more share a
word among the first n - ceil(LEAST * n) + 1 of each (the prefix), so lines meet in the lists of their
prefix words.  Length, position and bitmap filters drop most pairs that meet; the rest are verified on
their whole sets.

A line is removed if a line before it (in order of id, then line), kept or not, has similarity ``LEAST`` or
more.  Lines of equal sets are one class: within a stretch of input, and where they meet in the list of their
rarest word, all but the first are removed at once and take no further part.

Postings travel as columns of bytes, one row for each stretch of input and partition.  Of each line, a
list gives its likeliest candidate, which decides nearly all; where a list has more, it is kept, and lines
left undecided are compared with all candidates in it.  Postings of words that the sketch counts over
``hot`` times are dealt evenly first; once their lists' lengths are known, longer lists are cut into blocks
by hash, each two blocks a list of their own.

Defined cases: null text has no lines; a line without words is never removed and matches nothing; null
ids are ordered like the largest long; of rows that repeat whole (id and text), the first fares like a single row and
all lines with words of the others are later matches and go; ties
(rows of one id) go by a hash of the text (``deduplicated`` keeps the one whose other columns hash least); a very long text needs memory in proportion to its words; the
empty table gives no rows; columns besides the id and text columns are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm import words as W
from stratalens.llm.common import cut, discard, stored, tidy
from stratalens.llm.filters import passing, sized, wanted
from stratalens.llm.words import mix, texts

#: Similarity as a fraction of small integers.
LEAST = (4, 5)
#: Longest list that is not cut, 64-bit words of the bitmaps for verification, blobs of a sketch.
HOT, SIGNATURE, PIECES = 8192, 8, 16
#: Lines gathered at a time.
LINES = 1 << 17
#: Words whose postings go to one partition, postings of one of cut lists, copies of a row that are made together.
SHARE, CUT, COPIES = 1 << 23, 1 << 22, 1024
#: Bounds of the counters of the sketch, which follow the number of rows.
SKETCH = (1 << 14, 1 << 20)

#: What a line with words holds.
WORDED = r"[^\x20\x09-\x0D]"

_U = np.uint64


# --- words -----------------------------------------------------------------------------------------


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and line of each word, place of each line's first word), for texts that begin at ``starts``; ``ends`` are the places of breaks, if known.

    Lines are numbered by the breaks before them.
    """
    place, h = W.words(raw, starts)
    bounds = np.sort(np.concatenate((starts, (np.flatnonzero(raw == 10) if ends is None else ends) + 1)), kind="stable")
    first = np.searchsorted(place, bounds)
    n = np.diff(first, append=len(place))
    return h, np.repeat(np.arange(len(bounds)), n), place[first[n > 0]]


def _numbered(raw: np.ndarray, starts: np.ndarray, place: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, number in its text) of the lines that hold the bytes at ``place``."""
    text = np.searchsorted(starts, place, "right") - 1
    ends = np.flatnonzero(raw == 10) if ends is None else ends
    return text, np.searchsorted(ends, place) - np.searchsorted(ends, starts[text])


# --- rarity ----------------------------------------------------------------------------------------


def line_words(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Hashes of the words of the texts of a batch."""
    for _, raw, starts in texts(b.column("text")):
        yield W.words(raw, starts)[1]


def gathered(arrays: Iterable[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The same numbers in arrays of ``size`` at least, but for the last."""
    held, count = [], 0
    for x in arrays:
        held.append(x)
        count += len(x)
        if count >= size:
            yield np.concatenate(held)
            held, count = [], 0
    if held:
        yield np.concatenate(held)


def sketch(rows: DataFrame, slots: int, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]] = line_words) -> np.ndarray:
    """How often the ``hashes`` of the batches of ``rows`` (words of their column text) fall into each of ``slots`` slots."""
    part = slots // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for h in gathered((h & _U(slots - 1) for b in batches for h in hashes(b)), slots):
            counts += np.bincount(h.view(np.int64), minlength=slots)
        counts = counts.astype(np.min_scalar_type(counts.max()))
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([counts[i * part : (i + 1) * part].tobytes() for i in range(PIECES)])], names=["piece", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, n in zip(b.column("piece").to_pylist(), b.column("n")):
                n = n.as_buffer()
                own[piece] = own.get(piece, 0) + np.frombuffer(n, f"u{n.size // part}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["piece", "n"])

    kind = "piece int, n binary"
    out = np.zeros(slots, np.int64)
    for r in rows.mapInArrow(count, kind).repartitionById(PIECES, F.col("piece")).mapInArrow(add, kind).collect():
        out[r.piece * part : (r.piece + 1) * part] = np.frombuffer(r.n, np.int64)
    return out


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n words with any set similar to it."""
    return (LEAST[0] * n + LEAST[1] - 1) // LEAST[1]


def _order(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(stable order by ``cols``, the first before the others; what it was sorted by, in order).

    Keys of 64 bits that end in the place are sorted as numbers, several times as fast as places are.  Hashes come last: of
    them there is what has room, if only some bits are left over.  Where the others have no room, there is no key.
    """
    rows = len(cols[0])
    room = 64 - max(0, rows - 1).bit_length()
    key, left = np.zeros(rows, _U), room
    for c in cols if rows else ():
        rise = (c if c.dtype == _U else c.astype(np.int64).view(_U)) - _U(int(c.min()) & 0xFFFFFFFFFFFFFFFF)
        size = int(rise.max()).bit_length()
        if size > left:
            if c is not cols[-1] or c.dtype != _U or left < 8:
                return np.lexsort(cols[::-1]), None
            rise, size = rise >> _U(size - left), left
        if size:
            key, left = key << _U(size) | rise, left - size
    place = _U(64 - room)
    key = np.sort(key << place | np.arange(rows, dtype=_U))
    return (key & ((_U(1) << place) - _U(1))).view(np.int64), key >> place


def _exact(*cols: np.ndarray) -> np.ndarray:
    """Order by ``cols`` where the last are hashes that must not be mixed up."""
    order, k = _order(*cols)
    own = cols[-1][order]
    if k is not None and ((k[1:] == k[:-1]) & (own[1:] != own[:-1])).any():
        return np.lexsort(cols[::-1])
    return order


def _ordered(h: np.ndarray, rank: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by line, rank, hash."""
    return _exact(line, rank, h)


def _distinct(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each line's set in order, where each set begins, its size)."""
    order = _ordered(h, rank, line)
    h, line = h[order], line[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))
    h, line = h[new], line[new]
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    return h, begin, np.diff(begin, append=len(h))


def _named(h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set of word hashes, whatever their order."""
    return mix(np.add.reduceat(mix(h, 1), begin) + n.astype(_U))


# --- postings --------------------------------------------------------------------------------------

#: Columns of a posting: its list; the line's order (id, row's name, number), class, size and bitmap; the word's place.
_POSTED = {"list": np.uint64, "o": np.int64, "k": np.int64, "line": np.int32, "c": np.uint64, "n": np.int32, "bits": np.uint64, "at": np.int32}
_ROW = {c: _POSTED[c] for c in ("o", "k", "line")}
#: A row of a list that is kept.
_HELD = np.dtype([(c, t) for c, t in _POSTED.items() if c != "list"])
#: Rows between stages: lines that equal an earlier one, postings dealt to their partition, and postings of frequent words.
SAME, DEALT, WARM = 0, 1, 2
#: And after lists are compared: candidates, lists that have more of them, and the lines that these may help.
PAIR, LIST, MORE = 3, 4, 5


#: Columns of random bytes, which no arrangement compresses.
_RANDOM = ("c", "bits")


def _packs(col: dict[str, np.ndarray], kinds: dict, first: np.ndarray) -> Iterator[bytes]:
    """For each run of rows that begins at ``first``, its columns as bytes.

    Of a value goes what it exceeds the least of its run by, in as few bytes as any run needs, equal
    places of these bytes together, so that they compress.
    """
    rows = len(next(iter(col.values())))
    n = np.diff(first, append=rows)
    lows, flat = np.zeros((len(first), len(kinds)), _U), []
    for i, (c, t) in enumerate(kinds.items()):
        v = np.ascontiguousarray(col[c], t)
        low = np.minimum.reduceat(v, first).astype(np.int64 if np.issubdtype(t, np.signedinteger) else _U).view(_U)
        rise = v.astype(np.int64 if np.issubdtype(t, np.signedinteger) else _U).view(_U) - np.repeat(low, n)
        size = (int(rise.max()).bit_length() + 7) // 8
        lows[:, i] = low
        if size == 8 and c in _RANDOM:
            flat.append(rise.view(np.uint8).reshape(1, -1))
            continue
        flat.append(np.empty((size, rows), np.uint8))
        for at in range(size):
            flat[-1][at] = rise >> _U(8 * at)
    sizes = bytes(8 if c in _RANDOM and len(x) == 1 and x.size > rows else len(x) for c, x in zip(kinds, flat))
    for low, a, m in zip(lows, first.tolist(), n.tolist()):
        yield b"".join([m.to_bytes(8, "little"), sizes, low.tobytes(), *[x[:, a * (w := x.shape[1] // rows) : (a + m) * w].tobytes() for x in flat]])


def _packed(col: dict[str, np.ndarray], kinds: dict) -> bytes:
    """All rows (one at least) as one run."""
    return next(_packs(col, kinds, np.zeros(1, np.int64)))


def _unpacked(blob: bytes, kinds: dict) -> dict[str, np.ndarray]:
    rows, sizes, at, out = int.from_bytes(blob[:8], "little"), blob[8 : 8 + len(kinds)], 8 + 9 * len(kinds), {}
    for (c, t), size, low in zip(kinds.items(), sizes, np.frombuffer(blob, _U, len(kinds), 8 + len(kinds))):
        x = np.frombuffer(blob, np.uint8, rows * size, at)
        if size == 8 and c in _RANDOM:
            v = x.view(_U) + low
        else:
            v = np.full(rows, low)
            for i in range(size):
                v += x[i * rows : (i + 1) * rows].astype(_U) << _U(8 * i)
        out[c] = v.astype(t)
        at += rows * size
    return out


def _gathered(blobs: list[bytes], kinds: dict) -> dict[str, np.ndarray]:
    each = [_unpacked(b, kinds) for b in blobs]
    return {c: np.concatenate([np.zeros(0, t), *[x[c] for x in each]]) for c, t in kinds.items()}


def _dealt(col: dict[str, np.ndarray], part: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(partition, its postings).  With ``own``, other columns than list and at are those of the lines that ``own`` places postings at."""
    if not len(part):
        return
    order = _order(col["list"])[0]
    part = part[order]
    if (part[1:] < part[:-1]).any():
        again = np.argsort(part, kind="stable")
        order, part = order[again], part[again]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    line = order if own is None else own[order]
    col = {c: v[order if c in ("list", "at") else line] for c, v in col.items()}
    yield from zip(part[first].tolist(), _packs(col, _POSTED, first))


_BLOB = "part int, kind int, blob binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def _tied(x: np.ndarray) -> np.ndarray:
    """Places of what is not the only one of its value in the sorted ``x``."""
    same = x[1:] == x[:-1]
    return np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False]))) if len(x) else np.zeros(0, np.int64)


def _again(col: dict[str, np.ndarray], same: np.ndarray) -> np.ndarray:
    """Of rows in order of class, then line: those that repeat the class of the row before."""
    out = np.zeros(len(same), bool)
    for c in ("c", "n", "bits"):
        same &= col[c] == np.roll(col[c], 1)
    out[1:] = same[1:]
    return out


def _later(col: dict[str, np.ndarray], again: np.ndarray) -> np.ndarray:
    """Of the rows that are ``again``, those that are not the first occurrence itself (rows may repeat)."""
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
    return again & np.any([col[c] != col[c][lead] for c in _ROW], axis=0)


def _postings(rarity: np.ndarray, hot: int, parts: int):
    # 1024 classes of frequency, finer for rare words, are enough to put rare words first
    rank = np.minimum(np.log2(rarity + 1.0) * 24, 1023).astype(np.uint64)
    warm, last = rarity > hot, _U(len(rarity) - 1)

    def made(held: list[tuple], spread: int) -> pa.RecordBatch:
        names = ("o", "k", "line", "c", "n", "bits")
        col = {c: np.concatenate([x[i] for x in held]) for i, c in enumerate(names)}
        head, p = np.concatenate([x[-2] for x in held]), np.concatenate([x[-1] for x in held])
        order = _order(col["o"], col["k"], col["line"])[0]
        order = order[_order(col["c"][order])[0]]
        col = {c: v[order] for c, v in col.items()}
        again = _again(col, np.ones(len(order), bool))
        gone = _later(col, again)
        rows = [(spread % parts, SAME, _packed({c: col[c][gone] for c in _ROW}, _ROW))] if gone.any() else []
        own = np.flatnonzero(~again)
        begin, size = (np.cumsum(p) - p)[order[own]], p[order[own]]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        h, own = head[np.repeat(begin, size) + at], np.repeat(own, size)
        part = (h >> _U(32)) % _U(parts)
        lists, at = part << _U(32) | h & _U(0xFFFFFFFF), at.astype(np.int32)
        hottest = warm[(h & last).astype(np.int64)]
        if hottest.any():
            w = own[hottest]
            rows.append((spread % parts, WARM, _packed({"list": lists[hottest], **{c: v[w] for c, v in col.items()}, "at": at[hottest]}, _POSTED)))
            rest = ~hottest
            lists, at, part, own = lists[rest], at[rest], part[rest], own[rest]
        return _blobs(rows + [(x, DEALT, blob) for x, blob in _dealt({"list": lists, **col, "at": at}, part, own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, held, count = TaskContext.get().partitionId(), [], 0
        for b in batches:
            o, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("o", "k"))
            for at, raw, starts in texts(b.column("text")):
                ends = np.flatnonzero(raw == 10)
                h, line, place = _words(raw, starts, ends)
                if not len(h):
                    continue
                h, begin, n = _distinct(h, line, rank[(h & last).astype(np.int64)])
                text, number = _numbered(raw, starts, place, ends)
                bits = np.bitwise_xor.reduceat(_U(1) << (h >> _U(58)), begin)
                p = n - needed(n) + 1
                head = h[np.arange(p.sum()) + np.repeat(begin - (np.cumsum(p) - p), p)]
                held.append((o[at + text], k[at + text], number.astype(np.int32), _named(h, begin, n), n.astype(np.int32), bits, head, p))
                count += len(n)
                if count >= LINES:
                    yield made(held, spread)
                    spread, held, count = spread + 1, [], 0
        if held:
            yield made(held, spread)

    return run


# --- lists -----------------------------------------------------------------------------------------


def _met(lists: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of the pairs of rows of a list that pass the filters; rows in order of list, then size.

    A pair may be missed where it meets at a word that is not the first it shares: there it meets elsewhere.
    """
    i = np.arange(max(0, len(n) - 1))
    step = 1
    while len(i):
        i = i[i + step < len(n)]
        i = i[(lists[i] == lists[i + step]) & (LEAST[0] * n[i + step] <= LEAST[1] * n[i])]
        both = n[i] + n[i + step]
        least = -(-LEAST[0] * both // (LEAST[0] + LEAST[1]))
        fits = np.flatnonzero(np.minimum(n[i] - at[i], n[i + step] - at[i + step]) >= least)
        a = i[fits]
        apart = np.bitwise_count(bits[a] ^ bits[a + step]).astype(np.int32)
        close = (both[fits] - apart) // 2 >= least[fits]
        yield a[close], a[close] + step, apart[close]
        step += 1


_FOUND = {"kind": np.int32, "yo": np.int64, "yk": np.int64, "yl": np.int32, "yc": np.uint64, "xo": np.int64, "xl": np.int32, "xc": np.uint64, "list": np.uint64}
_FOUND_KIND = "kind int, yo long, yk long, yl int, yc long, xo long, xl int, xc long, list long, blob binary"
_SIGNED = {np.uint64: np.int64}


def _rows(kind: int, count: int, blobs: list | None = None, **cols: np.ndarray) -> pa.RecordBatch:
    made = []
    for c, t in _FOUND.items():
        own = np.full(count, kind, t) if c == "kind" else np.ascontiguousarray(cols.get(c, np.zeros(count)), t)
        made.append(pa.array(own.view(_SIGNED.get(t, t))))
    return pa.RecordBatch.from_arrays([*made, pa.array(blobs or [None] * count, pa.binary())], names=[*_FOUND, "blob"])


def _side(col: dict[str, np.ndarray], rows: np.ndarray, which: str) -> dict[str, np.ndarray]:
    names = {"yo": "o", "yk": "k", "yl": "line", "yc": "c"} if which == "y" else {"xo": "o", "xl": "line", "xc": "c"}
    return {c: col[own][rows] for c, own in names.items()}


def _compared(col: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What the lists of a partition have to say of their lines."""
    order = _exact(col["list"])
    lists = col["list"][order]
    which = np.cumsum(np.concatenate(([False], lists[1:] != lists[:-1]))) if len(lists) else order
    tied = _tied(lists)  # what is alone in its list meets nothing
    if not len(tied):
        return
    order, which = order[tied], which[tied]
    by = _order(*[col[c][order] for c in ("o", "k", "line")])[0]
    order, which = order[by], which[by]
    rank = _order(which, col["n"][order], col["c"][order])[0]
    order = order[rank]
    col = {c: v[order] for c, v in col.items()}
    again = _again(col, col["list"] == np.roll(col["list"], 1))
    gone = np.flatnonzero(_later(col, again) & (col["at"] == 0))
    if len(gone):
        yield _rows(SAME, len(gone), **_side(col, gone, "y"))
    col, rank = {c: v[~again] for c, v in col.items()}, rank[~again]
    size = len(rank)
    by_rank = np.empty(len(order), np.int64)
    by_rank[rank] = np.arange(size)
    most = np.iinfo(np.int64).max
    best, hits = np.full(size, most), np.zeros(size, np.int64)
    for i, j, apart in _met(col["list"], col["n"], col["at"], col["bits"]):
        key = (apart.astype(np.int64) * 1024 // (col["n"][i] + col["n"][j])) << 40
        after = rank[j] > rank[i]
        for y, x, own in ((j[after], i[after], key[after]), (i[~after], j[~after], key[~after])):  # no line twice in either
            best[y] = np.minimum(best[y], own | rank[x])
            hits[y] += 1
    y = np.flatnonzero(hits)
    if len(y):
        x = by_rank[best[y] & ((1 << 40) - 1)]
        yield _rows(PAIR, len(y), **_side(col, y, "y"), **_side(col, x, "x"))
    y = np.flatnonzero(hits > 1)
    if not len(y):
        return
    first = np.flatnonzero(np.concatenate(([True], col["list"][1:] != col["list"][:-1])))
    stop = np.append(first[1:], size)
    own = np.searchsorted(first, y, "right") - 1
    yield _rows(MORE, len(y), **_side(col, y, "y"), xl=y - first[own], list=col["list"][y])
    which = np.unique(own)
    held = np.empty(size, _HELD)
    for c in _HELD.names:
        held[c] = col[c]
    for at in range(0, len(which), 1024):
        some = which[at : at + 1024]
        yield _rows(LIST, len(some), [held[a:z].tobytes() for a, z in zip(first[some], stop[some])], list=col["list"][first[some]])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob")):
            if kind == DEALT:
                held.append(blob.as_py())
            elif kind == SAME:
                own = _unpacked(blob.as_py(), _ROW)
                yield _rows(SAME, len(own["o"]), yo=own["o"], yk=own["k"], yl=own["line"])
            else:
                yield _rows(WARM, 1, [blob.as_py()])
    if held:
        yield from _compared(_gathered(held, _POSTED))


def candidates(rows: DataFrame, hot: int) -> list[DataFrame]:
    """Stored tables of what the lists say: equal lines, pairs, and lists that have more."""
    spark = rows.sparkSession
    rarity = sketch(rows.select("text"), sized(4 * rows.count(), SKETCH))
    # a task holds a partition's postings, so their number follows the words
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rarity.sum()) // SHARE))
    dealt = rows.mapInArrow(_postings(rarity, hot, parts), _BLOB)
    found = stored(dealt.repartitionById(parts, F.col("part")).mapInArrow(_candidates, _FOUND_KIND))
    tidy(spark)
    warm = found.where(F.col("kind") == WARM).select("blob")
    slots = 1 << 16

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob"):
                lists, n = np.unique(_unpacked(blob.as_py(), _POSTED)["list"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(n)], names=["list", "n"])

    sizes = warm.mapInArrow(counted, "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    slot = F.pmod("list", F.lit(slots))
    blocks, copied = np.zeros(slots, np.int64), 0
    for r in sizes.groupBy(slot.alias("slot")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).collect():  # at most ``slots`` rows
        blocks[r.slot] = -(-r.n // hot)
        copied += r.all * int(blocks[r.slot])
    if not blocks.any():
        return [found]
    parts = max(parts, -(-copied // CUT))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob"):
                col = _unpacked(blob.as_py(), _POSTED)
                many = blocks[col["list"].view(np.int64) % slots]
                row = np.repeat(np.arange(len(many)), many)
                other, own = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many), (col["c"] % many.astype(_U)).astype(np.int64)[row]
                col = {c: v[row] for c, v in col.items()}
                pair = np.minimum(own, other) << 32 | np.maximum(own, other)
                # each two blocks of a list are a list, to which rows of either go
                col["list"] = np.where(many[row] > 1, mix(col["list"] + mix(pair.astype(_U), 3)), col["list"])
                part = (mix(col["list"], 4) % _U(parts)).astype(np.int64)
                yield _blobs([(x, DEALT, own) for x, own in _dealt(col, part)])

    return [found, stored(warm.mapInArrow(split, _BLOB).repartitionById(parts, F.col("part")).mapInArrow(_candidates, _FOUND_KIND))]


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates, in lists that were kept, of the lines at the places asked for; many lists at once."""
    for b in batches:
        each = [np.frombuffer(x.as_buffer(), _HELD) for x in b.column("blob")]
        sizes = np.array([len(x) for x in each], np.int64)
        done = 0
        while done < len(each):
            upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), 1 << 18)) + done)
            some, size = each[done:upto], sizes[done:upto]
            joined = np.concatenate(some)
            col = {c: np.ascontiguousarray(joined[c]) for c in _HELD.names}
            asked, rank = np.zeros(size.sum(), bool), np.empty(size.sum(), np.int64)
            for first, held, places in zip(np.cumsum(size) - size, size, b.column("places").slice(done, upto - done)):
                places = places.values.to_numpy()
                asked[first + places[places < held]] = True
            rank[np.lexsort((col["line"], col["k"], col["o"]))] = np.arange(len(rank))
            for i, j, _ in _met(np.repeat(np.arange(len(size)), size), col["n"], col["at"], col["bits"]):
                after = rank[j] > rank[i]
                y, x = np.where(after, j, i), np.where(after, i, j)
                own = asked[y]
                if own.any():
                    yield _rows(PAIR, int(own.sum()), **_side(col, y[own], "y"), **_side(col, x[own], "x"))
            done = upto


# --- verification ----------------------------------------------------------------------------------


def sets(rows: DataFrame, places: DataFrame, count: int | None = None) -> DataFrame:
    """(c, n, sig, words): the whole word sets, and their parity bitmaps of 64 * SIGNATURE bits, of the lines at ``places`` (and of some that share their filter bit)."""
    bits = rows.sparkSession.sparkContext.broadcast(wanted(places, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = b.column("o").to_numpy(zero_copy_only=False)
            for at, raw, starts in texts(b.column("text")):
                ends = np.flatnonzero(raw == 10)
                begin = np.sort(np.concatenate((starts, ends + 1)))
                text = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(ends, starts), append=len(ends)) + 1)
                number = np.arange(len(begin)) - np.searchsorted(text, text)
                picked = passing(bits.value, o[at + text], number)
                stop = np.append(begin[1:], len(raw))
                long = stop[picked] - begin[picked]
                if not long.sum():
                    continue
                own = np.arange(long.sum()) + np.repeat(begin[picked] - (np.cumsum(long) - long), long)
                h, line, _ = _words(raw[own], (np.cumsum(long) - long)[long > 0])
                if not len(h):
                    continue
                h, first, n = _distinct(h, line, np.zeros(len(h), _U))
                words = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(h.view(np.int64)))
                wide = np.zeros((len(first), SIGNATURE), _U)
                np.bitwise_xor.at(wide, (np.repeat(np.arange(len(first)), n), (h >> _U(8)) % _U(SIGNATURE)), _U(1) << (h & _U(63)))
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * SIGNATURE, pa.int32()), pa.array(wide.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_named(h, first, n).view(np.int64)), pa.array(n, pa.int64()), sigs, words], names=["c", "n", "sig", "words"])

    return rows.select("o", "text").mapInArrow(run, "c long, n long, sig array<long>, words array<long>")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the ``pairs`` whose whole sets are similar, as (yo, yk, yl).

    Wide bitmaps go first: two sets share at most half of what their sizes exceed their bitmaps'
    difference by.  That leaves few pairs that are not similar, so few sets are moved in vain.
    """
    pairs = cut(pairs.select("yo", "yk", "yl", F.col("yc").alias("y"), "xo", "xl", F.col("xc").alias("x")).distinct())
    places = pairs.select(F.explode(F.array(F.struct(F.col("yo").alias("o"), F.col("yl").alias("line")), F.struct(F.col("xo").alias("o"), F.col("xl").alias("line")))).alias("at")).select("at.*")
    count = places.agg(F.approx_count_distinct(F.struct("o", "line"))).first()[0]  # sizes the filter only
    # lines of one set are named alike: one of them is enough
    have = stored(sets(rows, places, count).dropDuplicates(["c"]))
    side = lambda k, *cols: have.select(F.col("c").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
    slim = pairs.select("y", "x").distinct().join(side("y", "n", "sig"), "y").join(side("x", "n", "sig"), "x")
    apart = F.aggregate(F.zip_with("y_sig", "x_sig", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, d: t + d)
    total = F.col("y_n") + F.col("x_n")
    close = cut(slim.where(F.floor((total - apart) / 2) * (LEAST[0] + LEAST[1]) >= total * LEAST[0]).select("y", "x"))
    need = lambda k: side(k, "words").join(close.select(k).distinct(), k, "left_semi")
    both = close.join(need("y"), "y").join(need("x"), "x")
    common = F.size(F.array_intersect("y_words", "x_words"))
    alike = cut(both.where(common * (LEAST[0] + LEAST[1]) >= LEAST[0] * (F.size("y_words") + F.size("x_words"))).select("y", "x"))
    out = cut(pairs.join(alike, ["y", "x"], "left_semi").select("yo", "yk", "yl").distinct())
    discard(have)
    tidy(rows.sparkSession)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str, key: tuple[Column, Column, bool] | None = None) -> DataFrame:
    """(o, k, text): the order by id, nulls last, and what tells rows of one id apart; ``key`` is their ``row_key``, if known."""
    o, k, _ = key or row_key(docs, id_col, text_col)
    return docs.select(o.alias("o"), k.alias("k"), F.col(text_col).alias("text"))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, bool]:
    """The names (o, k) of a row, and whether ids repeat: where none does, the id says all; else a hash of the text goes with it."""
    o = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    repeated = docs.groupBy(o.alias("o")).count().where("count > 1").limit(1).count()
    return o, F.xxhash64(F.lit("lines"), F.col(id_col).cast("long"), F.col(text_col)) if repeated else F.lit(0).cast("long"), bool(repeated)


def removed(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(o, k, line) of the lines that are removed."""
    made = candidates(rows, hot)
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    of = lambda kind: found.where(F.col("kind") == kind)
    name = ["yo", "yk", "yl"]
    gone = of(SAME).select(*name).unionByName(verified(of(PAIR), rows))
    open_ = of(MORE).select(*name, "list", F.col("xl").alias("place")).join(gone, name, "left_anti")
    places = cut(open_.groupBy("list").agg(F.collect_set("place").alias("places")))
    if places.limit(1).count():
        # the rest: lines whose likeliest candidates are not similar, compared with all others
        rest = of(LIST).select("list", "blob").join(places, "list").select("blob", "places").mapInArrow(_rest, _FOUND_KIND)
        gone = gone.unionByName(verified(rest, rows))
    gone = cut(gone.select(F.col("yo").alias("o"), F.col("yk").alias("k"), F.col("yl").alias("line")).distinct())
    for table in made:
        discard(table)
    tidy(rows.sparkSession)
    return gone


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, key: tuple[Column, Column, bool] | None = None) -> DataFrame:
    """(o, k, removed): the row's name and the numbers of its removed lines, for rows that lose any."""
    return removed(keyed(docs, id_col, text_col, key), hot).groupBy("o", "k").agg(F.array_sort(F.collect_list(F.col("line").cast("long"))).alias("removed"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_lines, removed) for each row."""
    text = F.col(text_col)
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    o, k, repeated = key = row_key(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).alias(id_col), F.coalesce(lines, F.lit(0)).alias("n_lines"), o.alias("o"), k.alias("k"))
    first = slim.dropDuplicates(["o", "k"]) if repeated else slim
    out = first.join(removals(docs, id_col, text_col, hot, key), ["o", "k"], "left")
    out = out.select(id_col, "n_lines", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))
    if not repeated:
        return out
    often = slim.groupBy("o", "k").agg(F.count("*").alias("n"), F.min(id_col).alias(id_col), F.min("n_lines").alias("n_lines")).where("n > 1")
    worded = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(x.rlike(WORDED), i.cast("long"))), lambda i: i.isNotNull())
    texts_of = docs.select(o.alias("o"), k.alias("k"), text.alias("text")).join(often.select("o", "k"), ["o", "k"], "left_semi").dropDuplicates(["o", "k"])
    texts_of = texts_of.select("o", "k", F.coalesce(worded, F.array().cast("array<bigint>")).alias("removed"))
    # copies are made in runs that are dealt evenly, however many there are
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = often.join(texts_of, ["o", "k"]).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / COPIES))))
    copies = F.sequence(F.col("run") * COPIES, F.least(F.col("n") - 1, (F.col("run") + 1) * COPIES) - 1)
    later = runs.repartition(parts, "o", "k", "run").withColumn("copy", F.explode(copies))
    return out.unionByName(later.select(id_col, "n_lines", "removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; rows that lose all lines with words are left out."""
    o, k, repeated = key = row_key(docs, id_col, text_col)
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*own).alias("doc"), o.alias("o"), k.alias("k"))
    if repeated:
        # later copies lose all lines with words, and so go
        named = docs.select(F.struct(*own).alias("doc"), o.alias("o"), k.alias("k"), F.xxhash64(*own).alias("name"), F.coalesce(F.col(text_col).rlike(WORDED), F.lit(False)).alias("worded"))
        first = named.where("worded").groupBy("o", "k").agg(F.min("name").alias("name"))
        once = named.where("worded").join(first, ["o", "k", "name"]).dropDuplicates(["o", "k"])
        whole = once.select("doc", "o", "k").unionByName(named.where("NOT worded").select("doc", "o", "k"))
    joined = whole.join(removals(docs, id_col, text_col, hot, key), ["o", "k"], "left")
    text = F.col("doc").getField(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    joined = joined.withColumn("kept", F.when(F.col("removed").isNull(), text).otherwise(kept))
    joined = joined.where(F.col("removed").isNull() | F.col("kept").rlike(WORDED))
    return joined.select(*[F.col("kept").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its lines, how many are removed, and which (numbered from 0)."""
    return marked(docs).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"))
