"""Bit filters of places (o, line) that the driver builds and broadcasts; what passes by chance does no harm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.words import mix

#: Bounds of the bits of a filter, which follow the number of its places.
BITS = (1 << 16, 1 << 28)

_U = np.uint64


def sized(n: int, bounds: tuple[int, int]) -> int:
    """The power of two from ``n``, within ``bounds``."""
    return min(max(1 << max(0, n - 1).bit_length(), bounds[0]), bounds[1])


def _slot(o: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (mix(o.view(_U) + mix(line.astype(np.int64).view(_U), 3)) & _U(bits - 1)).astype(np.int64)


def wanted(places: DataFrame, count: int | None = None) -> np.ndarray:
    """A filter of the ``places`` (o long, line), which may repeat, of 16 bits to each of them within the bounds of BITS.

    ``count`` is about how many different ones there are, where the caller knows.
    """
    size = sized(16 * (places.count() if count is None else count), BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 8, np.uint8)
        for b in batches:
            s = _slot(*(np.ascontiguousarray(b.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("o", "line")), size)
            np.bitwise_or.at(held, s >> 3, (1 << (s & 7)).astype(np.uint8))
        words = held.view(np.int64)
        own = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own])], names=["at", "word"])

    out = np.zeros(size // 64, np.int64)
    found = places.select("o", "line").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[found["at"].to_numpy()] = found["word"].to_numpy()
    return out.view(np.uint8)


def passing(bits: np.ndarray, o: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which of the places pass."""
    s = _slot(o, line, len(bits) * 8)
    return np.flatnonzero(bits[s >> 3] >> (s & 7).astype(np.uint8) & 1)
