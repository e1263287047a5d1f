"""Document fingerprints from locally consistent parsing.

A text is parsed in levels.  On each level, runs of one symbol become one symbol; deterministic coin
tossing then relabels each symbol by the lowest bit in which it differs from the one before (and that
bit), a few times, until six labels are left; symbols whose label is a local maximum start phrases; a
phrase's name is a hash of its symbols.  A label depends on a few symbols in front of it only, so
equal substrings are cut into equal phrases but for a few at their ends, wherever they stand.

The fingerprint is a one-permutation min-hash (``BINS`` values of 16 bits, as hex) of the names of the
phrases of levels 2 and 3, of about 10 and 30 characters.  The likeness of two fingerprints is the
share of equal values among the bins that either of them fills; two without phrases are alike.

Texts are compared with their neighbour in descending id order.  Rows are dealt to ranges of ids of
about ``RANGE`` rows, and each range also gets the first row of the range after it, so the order needs
no single task.  An id that many rows share is cut into ranges of its own, by their texts' hashes.

Defined cases: a very long text is parsed alone, in memory in proportion to it; the empty table gives no rows; null text is the empty text, whose fingerprint has no filled bin; null ids come last in
the order, in order of their texts' hashes, as rows with equal ids do; repeated rows are all returned;
columns besides the id and text columns are ignored; a table of one row has itself as neighbour.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64
#: Rows of an id range on average; the most ranges (and ids cut apart), so that the driver holds a bounded list of them.
RANGE, RANGES = 1024, 20_000
#: Characters parsed at a time (a longer text is parsed alone).
SLICE = 1 << 20
#: Levels whose phrase names make the fingerprint.
LEVELS = (2, 3)

_U = np.uint64
_EMPTY = np.uint16(0xFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser, public domain)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd multipliers for the places of a phrase.
_PLACES = _mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def _toss_table() -> np.ndarray:
    """New label of each (previous label, label) below 128; equal labels are told apart by bit 0."""
    prev, own = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = np.bitwise_count(((prev ^ own) & -(prev ^ own)) - 1)
    low = np.where(prev == own, 0, low)
    return (2 * low + (own >> low & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0..5 of the symbols ``x``; ``first`` are the places where texts start."""
    diff = np.empty_like(x)
    diff[1:] = x[1:] ^ x[:-1]
    diff[first] = _U(1)
    diff[diff == 0] = _U(1)
    low = np.bitwise_count((diff & (~diff + _U(1))) - _U(1))
    label = (2 * low + ((x >> low.astype(np.uint64)) & _U(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        at = np.empty(len(label), np.uint16)
        at[1:] = label[:-1].astype(np.uint16) << 7
        at[first] = (label[first] ^ 1).astype(np.uint16) << 7
        label = _TOSS[at | label]
    return label


def _level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level, and where each text's phrases start."""
    keep = np.empty(len(names), bool)
    keep[1:] = names[1:] != names[:-1]
    keep[first] = True
    at = np.flatnonzero(keep)
    run = np.diff(at, append=len(names))
    x = names[at]
    long = np.flatnonzero(run > 1)
    x[long] = _mix(x[long] + _mix(run[long].astype(np.uint64)))
    first = np.searchsorted(at, first)
    label = _labels(x, first)
    top = np.zeros(len(x), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    top[first[1:] - 1] = False  # the last symbol of a text has none after it
    top[first] = True
    begin = np.flatnonzero(top)
    size = np.diff(begin, append=len(x))
    place = np.arange(len(x)) - np.repeat(begin, size)
    names = _mix(np.add.reduceat(_mix(x) * _PLACES[place & 63], begin) + size.astype(np.uint64))
    return names, np.searchsorted(begin, first)


def sketches(texts: list[str]) -> np.ndarray:
    """One row of BINS 16-bit values for each text."""
    out = np.full((len(texts), BINS), _EMPTY, np.uint16)
    part, size = [], 0
    for i in range(len(texts) + 1):
        if part and (i == len(texts) or size + len(texts[i]) > SLICE):
            _sketch(texts, part, out)
            part, size = [], 0
        if i < len(texts) and texts[i]:
            part.append(i)
            size += len(texts[i])
    return out


def _sketch(texts: list[str], part: list[int], out: np.ndarray) -> None:
    flat = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(texts[i]) for i in part])
    first = np.cumsum(lengths) - lengths
    table = np.full(len(part) * BINS, _EMPTY, np.uint16)
    names = flat
    for level in range(1, max(LEVELS) + 1):
        names, first = _level(names, first)
        if level in LEVELS:
            owner = np.repeat(np.arange(len(part)), np.diff(first, append=len(names)))
            value = np.minimum((names >> _U(48)).astype(np.uint16), np.uint16(0xFFFE))
            np.minimum.at(table, owner * BINS + (names % _U(BINS)).astype(np.int64), value)
    out[part] = table.reshape(len(part), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of sketches: equal values among bins that either fills; 1 if neither fills any."""
    filled = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != _EMPTY)).sum(axis=1)
    return np.where(filled == 0, 1.0, equal / np.maximum(filled, 1))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fingerprint": _hex(sketches(b["text"].tolist()))})

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInPandas(run, "id string, fingerprint string").withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col]))


def _longs(values: list[int]) -> Column:
    """A constant array, which takes no node of the plan for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _count_upto(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``, in two steps of about sqrt(len(cuts)) each."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    every, coarse = _longs(cuts), _longs(cuts[::step])
    whole = F.size(F.filter(coarse, lambda c: c <= x))
    return F.transform(F.array(whole), lambda k: F.when(k == 0, 0).otherwise(
        (k - 1) * step + F.size(F.filter(F.slice(every, (k - 1) * step + 1, F.lit(step)), lambda c: c <= x))
    ))[0]


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE) -> DataFrame | None:
    """(id, text, guest): a partition for each range of descending ids, in order.  After a range's own
    rows comes a guest, the row that follows them (after the last range, the very first row).  None if
    there are no rows."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    total = ids.count()
    n = max(1, min(RANGES, -(-total // rows)))
    cuts = {int(c) for c in ids.na.drop().approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n))} if n > 1 else set()
    # an id that many rows share is a stretch by itself; there are at most RANGES of them
    often = max(2 * rows, -(-total // RANGES))
    many = {r["id"]: -(-r["count"] // rows) for r in ids.na.drop().groupBy("id").count().where(F.col("count") > often).collect()}
    cuts = sorted(cuts | many.keys() | {c + 1 for c in many if c + 1 < 2**63})
    # stretches count from the highest ids, each of one range or, for such an id, of several, by its texts' hashes
    held = [1] + [many.get(c, 1) for c in cuts]
    held = held[::-1]
    first = list(accumulate([0, *held[:-1]]))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1)
    share = lambda k: F.least(F.floor(tie / F.lit(2.0**63) * k), k - 1)
    stretch = (F.lit(len(cuts)) - _count_upto(F.col("id"), cuts)).cast("int")
    own = F.get(_longs(first), stretch) + share(F.get(_longs(held), stretch)) if many else stretch
    # null ids follow, dealt by hash to as many ranges again
    at = F.when(F.col("id").isNull(), F.lit(sum(held)) + share(F.lit(n))).otherwise(own).cast("int")
    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = placed.select("id", "text", at.alias("range"), F.col("id").isNull().alias("last"), F.bitwise_not("id").alias("down"), tie.alias("tie"))
    head = F.min(F.struct("last", "down", "tie")).alias("head")
    heads = sorted((r["range"], tuple(r["head"])) for r in placed.groupBy("range").agg(head).collect())
    if not heads:
        return None
    follow = [(heads[i - 1][0], *row) for i, (_, row) in enumerate(heads)]
    # at most 5 * RANGES rows of four numbers
    to = F.broadcast(docs.sparkSession.createDataFrame(follow, "to int, last boolean, down long, tie long"))
    same = (placed["last"] == to["last"]) & placed["down"].eqNullSafe(to["down"]) & (placed["tie"] == to["tie"])
    guests = placed.join(to, same).select("id", "text", F.col("to").alias("range"), placed["last"], placed["down"], placed["tie"], F.lit(True).alias("guest"))
    every = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    return every.repartitionById(heads[-1][0] + 1, F.col("range")).sortWithinPartitions("guest", "last", "down", "tie").select("id", "text", "guest")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row but guests: its sketch, that of its edited text, and their likenesses."""
    held: tuple | None = None  # the last row so far, with its sketch
    done = False
    for b in batches:
        if done or not len(b):
            continue
        own = int((~b["guest"]).sum())
        b = b.iloc[: own + 1]
        done = own < len(b)
        ids, texts = b["id"].tolist(), b["text"].tolist()
        made = sketches(texts)
        if held:
            ids, texts, made = [held[0], *ids], [held[1], *texts], np.concatenate((held[2], made))
        cut = [len(t) // 3 for t in texts[:-1]]
        edited = [t[: len(t) - k] + after[:k] for t, after, k in zip(texts, texts[1:], cut)]
        other = sketches(edited)
        yield pd.DataFrame({
            "id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "fingerprint": _hex(made[:-1]), "edited_fingerprint": _hex(other),
            "near_edited": likeness(made[:-1], other), "near_next": likeness(made[:-1], made[1:]),
        })
        held = (ids[-1], texts[-1], made[-1:])


_COMPARED = "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE) -> DataFrame:
    """Each row's fingerprint, that of its edited text (its last third replaced by the start of the next
    row's text), and its likeness to the edited text and to the next row."""
    ranges = in_ranges(docs, id_col, text_col, rows)
    if ranges is None:
        return docs.sparkSession.createDataFrame([], _COMPARED.replace("id string", f"{id_col} long"))
    # ids pass through pandas as strings, which keep nulls and large numbers as they are
    made = ranges.withColumn("id", F.col("id").cast("string")).mapInPandas(_compared, _COMPARED)
    return made.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``."""
    return compared(docs)
