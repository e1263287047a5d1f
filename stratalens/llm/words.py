"""Words of many texts at once: their places and hashes from Arrow's buffers, without a loop in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed at a time.
SLICE = 1 << 18

_U = np.uint64


def spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space: 9 to 13 and 32."""
    return (raw - np.uint8(9) < 5) | (raw == 32)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser, public domain)."""
    x = x + _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A word's hash is a polynomial over its bytes, so running sums give it without a loop.
_BASE, _LONG = 0x9E3779B97F4A7C13, 256
_powers: list[np.ndarray] = []


def _table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(max(n, SLICE), base, _U)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


def hashed(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each word of ``raw``; words end at white space and where texts start."""
    space = np.flatnonzero(spaces(raw))
    # what lies between two breaks, of which white space is one byte wide and a text's start none
    begin = np.sort(np.concatenate(([0], starts, space + 1)), kind="stable")
    end = np.sort(np.concatenate((starts, space, [len(raw)])), kind="stable")
    whole = np.flatnonzero(end > begin)
    begin, end = begin[whole], end[whole]
    power, inverse = _table(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    value = total[1:]
    value[:] = raw
    value += _U(1)
    value *= power[: len(raw)]
    np.cumsum(value, out=value)
    size = end - begin
    h = mix((total[end] - total[begin]) * inverse[begin] + size.astype(_U))
    for i in np.flatnonzero(size > _LONG):  # where sums of powers would no longer tell words apart
        h[i] = xxhash.xxh64_intdigest(raw[begin[i] : end[i]].tobytes(), 1)
    return begin, h


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``hashed``; long texts are hashed in pieces cut at white space."""
    places, hashes, a = [np.zeros(0, np.int64)], [np.zeros(0, _U)], 0
    while a < len(raw):
        b = a + SLICE
        if b < len(raw):
            own = np.flatnonzero(spaces(raw[a:b]))
            if len(own):
                b = a + int(own[-1]) + 1
            else:
                while b < len(raw) and not spaces(raw[b : b + 1])[0]:
                    b += 1
        b = min(b, len(raw))
        place, h = hashed(raw[a:b], starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a)
        places.append(place + a)
        hashes.append(h)
        a = b
    return np.concatenate(places), np.concatenate(hashes)


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each text begins) for groups of whole texts of about ``SLICE`` bytes."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        if off[j] > off[i]:
            yield i, raw[off[i] : off[j]], off[i:j] - off[i]
        i = j
