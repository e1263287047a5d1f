"""SimHash near-duplicate detection with Golay-code fuzzy keys.

The 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary Golay code of length
23 is perfect: every word lies within 3 bits of exactly one codeword, so a segment decodes to a
12-bit codeword index.  A segment that differs in one bit may decode to another codeword, but one of
the indices of its one-bit neighbours (six at most) is the same.

Fingerprints that differ in at most 3 bits have, by the pigeonhole principle, two segments that
differ by one bit in total, or one bit in each of the three.  So each fingerprint is stored under
three keys (the index pair of two segments) and looked up under the pairs of neighbour indices: both
segments' neighbours for the first pair, one segment's at a time for the other two.  That meets every
pair within 3 bits; a join on the key verifies the distance, and the links' connected components
are the groups.

``representatives``, the pipeline's stage, links documents whose sets of five-word shingles have a
Jaccard similarity of at least 0.8; at 0.8 fingerprints differ in about 10 bits, beyond what their keys
meet.  So candidates share the group of their fingerprints or one of ``BANDS`` min-hash keys of ``ROWS``
minima each (a pair at 0.8 misses all with chance (1 - 0.8^4)^24, about 3 in a million, and less above).
First, ``STARS`` times at most, documents meet one of their key, by another hash each time, if they are not of its
group yet; no more once that links nothing or no long key is left.  Of the keys that are still not one group, short ones (at most ``LIST`` documents) let those outside
the group meet all others.  Documents of long ones, such as a template's, which share a band far below 0.8, go
through an exact prefix join: shingles are put in order of rarity (a sketch of counters says how often they occur
among these documents; any order is right), and similar sets of sizes m <= n share one among the first
m - ceil(8m/9) + 1 of the smaller and the first n - ceil(4n/5) + 1 of the larger.  Only these meet, with
filters by size and position, and lists of more than ``BLOCK`` are cut into blocks.  Parity bitmaps of the sets,
whose size follows them, drop only pairs that cannot be similar; the rest are verified on their whole sets of shingles.

Defined cases: a very long text is hashed in pieces, in memory in proportion to its words; the empty table
gives no rows; ties among a group's documents go to the smallest id; null text and text without words have fingerprint zero, linked like any other; equal
fingerprints are one node whatever the number of rows; a null id never becomes a component's id
(a component of null ids only has a null one); repeated rows are all returned; columns besides the
id and text columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import components, cut, discard, stored, tidy
from stratalens.llm.filters import passing, sized, wanted
from stratalens.llm.line_dedup import SKETCH, sketch
from stratalens.llm.words import mix, texts, words

SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory.
PIECE = 1 << 18
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
#: Segments as (lowest bit, number of bits).
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Pairs of segments, and whether both are looked up with their neighbours at once.
PAIRS = ((0, 1, True), (0, 2, False), (1, 2, False))
#: The stage's words in a shingle and least similarity of a link.
WIDTH, LEAST = 5, 0.8
#: Min-hash keys of a document, minima in each, shingles hashed at a time, most bits of a set's bitmap.
BANDS, ROWS, STRIP, BITMAP = 24, 4, 1 << 9, 1 << 16
#: Most rounds in which each key's documents meet one of them.
STARS = 3
#: Longest key whose documents meet without the prefix join, rows of a block of a long list of that join.
LIST, BLOCK = 64, 4096
#: Pairs of which the nodes are sent to all tasks.
SENT = 1 << 15
#: Names of sets that a task remembers, to make what goes with a set only once; others are made again.
SEEN = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD, _PLUS = (np.random.default_rng(SEED + k).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1) for k in range(2))
_BAND, _PLACE = (np.random.default_rng(SEED + k).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for k in (2, 3))


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles of ``width`` lower-cased words, ``PIECE`` at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        yield np.array([digest(whole[a:z], SEED) for a, z in zip(starts[at : at + PIECE], stops[at : at + PIECE])], np.uint64)


def _bits(pieces: list[np.ndarray]) -> int:
    """The fingerprint of hashes: each bit as in most of them."""
    ones = np.zeros(64, np.int64)
    for hashes in pieces:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > sum(map(len, pieces)), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the whole text's shingles of ``width`` lower-cased words."""
    return _bits(list(_hashes(text, width)))


def _grouped(raw: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """The hashes of each text's shingles of ``width`` lower-cased words, repeats included."""
    place, h = words(_LOWER[raw], starts)
    bounds = np.searchsorted(place, np.append(starts, len(raw)))
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        whole += h[j : len(h) - width + 1 + j] * _PLACE[j]
    whole = mix(whole)
    out = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        if 0 < z - a < width:  # fewer words: the whole sequence, marked by its length
            out.append(mix((h[a:z] * _PLACE[: z - a]).sum(dtype=np.uint64, keepdims=True), width - int(z - a)))
        else:
            out.append(whole[a : max(a, z - width + 1)])
    return out


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its shingles) of each row of a column of texts that holds any bytes."""
    for at, raw, starts in texts(column):
        for i, found in enumerate(_grouped(raw, starts, width)):
            yield at + i, found


def _set(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, in order."""
    held = np.sort(hashes)
    return held[np.concatenate(([True], held[1:] != held[:-1]))] if len(held) else held


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of the text's shingles, as sorted hashes."""
    return _set(np.concatenate([np.zeros(0, np.uint64), *[found for _, found in _sets(pa.array([text], pa.string()), width)]]))


def band_keys(held: np.ndarray) -> np.ndarray:
    """The min-hash keys of a set of shingles; the empty set has none."""
    if not len(held):
        return np.zeros(0, np.int64)
    held = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(held), STRIP):
        made = held[at : at + STRIP, None] * _ODD
        made += _PLUS
        np.minimum(least, made.min(axis=0), out=least)
    return mix((least * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64), 1).view(np.int64)


def bitmap(held: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as words of 64 bits: four bits or more for each shingle, BITMAP at most."""
    bits = min(BITMAP, 1 << max(6, (4 * len(held) - 1).bit_length()))
    counts = np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fps})

    # ids pass through pandas as strings, which keep nulls and large numbers as they are
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "id string, fp long").withColumn("id", F.col("id").cast("long"))


# --- Golay code ----------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


class Golay:
    """Decoding tables: the remainder of the 12 high bits, and the error of each remainder."""

    def __init__(self) -> None:
        self.high = np.array([_remainder(h << 11) for h in range(1 << 12)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        for weight in range(1, 4):
            for at in combinations(range(23), weight):
                word = sum(1 << b for b in at)
                self.error[_remainder(word)] = word

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        return (words ^ self.error[self.high[words >> 11] ^ (words & 0x7FF)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Indices of each word and of its one-bit neighbours, the word's own first; -1 for repeats."""
        flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
        found = self.index(words[:, None] ^ flips[None, :])
        own = found[:, :1].copy()
        rest = np.sort(found[:, 1:], axis=1)
        again = np.concatenate((np.zeros((len(words), 1), bool), rest[:, 1:] == rest[:, :-1]), axis=1) | (rest == own)
        rest[again] = -1
        most = int((rest >= 0).sum(axis=1).max(initial=0))
        return np.concatenate((own, -np.sort(-rest, axis=1)[:, :most]), axis=1)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]


def stored_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the three keys under which each fingerprint is stored."""
    own = [code.index(s) for s in _segments(fps)]
    keys = [(t << 24) | (own[a] << 12) | own[b] for t, (a, b, _) in enumerate(PAIRS)]
    return np.tile(np.arange(len(fps)), len(PAIRS)), np.concatenate(keys)


def sought_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys under which each fingerprint looks for others."""
    near = [code.near(s, bits) for s, (_, bits) in zip(_segments(fps), SEGMENTS)]
    rows, keys = [], []
    for t, (a, b, both) in enumerate(PAIRS):
        for i in range(near[a].shape[1]):
            for j in range(near[b].shape[1] if both or i == 0 else 1):
                x, y = near[a][:, i], near[b][:, j]
                ok = np.flatnonzero((x >= 0) & (y >= 0))
                rows.append(ok)
                keys.append((t << 24) | (x[ok] << 12) | y[ok])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Golay()
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            rows, keys = make(fps.view(np.uint64), code)
            yield pd.DataFrame({"key": keys, "fp": fps[rows]})

    return nodes.select("fp").mapInPandas(run, "key long, fp long")


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """All pairs (u, v), u < v, of the distinct fingerprints ``nodes.fp`` that differ in ``most`` (at most 3) bits.

    Either of a pair finds the other, so only the smaller one's stored keys and the larger one's
    sought keys need to meet.
    """
    if most > 3:
        raise ValueError("the keys meet pairs within 3 bits")
    stored = _keyed(nodes, stored_keys).select("key", F.col("fp").alias("u"))
    sought = _keyed(nodes, sought_keys).select("key", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)
    return stored.join(sought, (stored["key"] == sought["key"]) & near).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """(id, fp, component) for each row: ``component`` is the smallest id reachable over links."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes, most))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(rooted.join(least, "root").select("fp", "component"))
    return rows.join(named, "fp", "left").select("id", "fp", "component")


def _named(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), SEED)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, node, size, fp, bits, keys) for each row (id, text); rows of one set of shingles are one node,
    of which a task gives bits and keys at least once."""
    names = ["id", "node", "size", "fp", "bits", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, seen = np.zeros(0, np.uint64), set()
        empty = (_named(none), 0, 0, bitmap(none), band_keys(none))
        for b in batches:
            made = [empty] * b.num_rows
            for row, found in _sets(b.column("text"), width):
                held = _set(found)
                name = _named(held)
                again = name in seen
                if len(seen) < SEEN:
                    seen.add(name)
                made[row] = (name, len(held), _bits([found]), held[:0].view(np.int64) if again else bitmap(held), held[:0].view(np.int64) if again else band_keys(held))
            node, size, fp, bits, keys = zip(*made) if made else [()] * 5
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([none.view(np.int64), *x]))) for x in (bits, keys)]
            yield pa.RecordBatch.from_arrays([b.column("id"), signed(node), pa.array(size, pa.int64()), signed(fp), *lists], names=names)

    return docs.select("id", "text").mapInArrow(run, "id long, node long, size long, fp long, bits array<long>, keys array<long>")


def _alike(a: Column, b: Column, m: Column, n: Column, least: float) -> Column:
    """Whether sets of sizes m and n with the bitmaps a and b may be similar.

    Bitmaps differ in no more places than their sets do; the longer one is folded to the shorter one's size.
    """
    def fold(x: Column) -> Column:
        half = F.size(x) / 2
        return F.zip_with(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))

    # sizes within 0.5 of each other, so a fold is enough
    x, y = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, d: t + d)
    return (F.least(m, n) >= F.greatest(m, n) * least - 1e-6) & (apart <= (m + n) * ((1 - least) / (1 + least)) + 1e-6)


def _held(docs: DataFrame, ids: DataFrame, width: int, count: int) -> DataFrame:
    """(node, held): the sets of shingles of the rows with these ``count`` ``ids`` (and of some that share their filter bit)."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted(ids.select(F.col("id").alias("o"), F.lit(0).alias("line")), count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            own = passing(bits.value, np.ascontiguousarray(b.column("id").to_numpy(zero_copy_only=False)), np.zeros(b.num_rows, np.int64))
            text = b.column("text").take(pa.array(own))
            made = {i: _set(found) for i, found in _sets(text, width)}
            some = {_named(h): h for h in (made.get(i, np.zeros(0, np.uint64)) for i in range(len(own)))}
            for at in [x for x in some if x not in seen]:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([at], np.uint64).view(np.int64)), pa.array([some[at].view(np.int64)], pa.list_(pa.int64()))], names=["node", "held"])
            if len(seen) < SEEN:
                seen |= some.keys()

    return docs.select("id", "text").mapInArrow(run, "node long, held array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, have: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets of shingles ``have`` (node, held) are similar."""
    some = pairs.count()
    if not some:
        return pairs.select("u", "v")
    if some <= SENT:  # few pairs: their nodes are sent to where the sets lie, and no others move
        have = have.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("node"))), "node", "left_semi")
    # the sets meet row by row, so that long texts in many pairs need no more memory
    first, second = have.select(F.col("node").alias("u"), F.col("held").alias("a")), have.select(F.col("node").alias("v"), F.col("held").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(first, "u").join(second, "v").where(both >= (F.size("a") + F.size("b") - both) * least - 1e-6).select("u", "v")


def _alpha(total: Column, least: float) -> Column:
    """The least overlap of similar sets of ``total`` elements together."""
    return F.ceil(total * (least / (1 + least)) - 1e-6)


def _prefixes(have: DataFrame, least: float) -> DataFrame:
    """(node, size, keys): the rarest shingles of each set (node, held), in order, as many as a larger set is looked up by."""
    rarity = sketch(have.select("held"), sized(4 * have.count(), SKETCH), lambda b: [b.column("held").flatten().to_numpy(zero_copy_only=False).view(np.uint64)])
    counts = have.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.uint64(len(counts.value) - 1)
        for b in batches:
            sizes, keys = [], [np.zeros(0, np.int64)]
            for held in b.column("held"):
                h = held.values.to_numpy(zero_copy_only=False)  # in order of the hash, which breaks ties
                n = len(h)
                first = np.argsort(counts.value[(h.view(np.uint64) & last).astype(np.int64)], kind="stable")
                sizes.append(n)
                keys.append(h[first[: n - int(np.ceil(least * n - 1e-6)) + 1]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys[1:])]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sizes, pa.int64()), lists], names=["node", "size", "keys"])

    return have.where(F.size("held") > 0).select("node", "held").mapInArrow(run, "node long, size long, keys array<long>")


def prefix_pairs(have: DataFrame, roots: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of different roots, of the sets ``have`` (node, held) with ``roots`` (node, root), that may be similar: none that is is missing."""
    posted = stored(_prefixes(have, least))
    smaller = F.col("at") <= F.col("size") - _alpha(2 * F.col("size"), least)
    every = posted.join(roots, "node").select("node", "root", "size", F.posexplode("keys").alias("at", "key")).withColumn("first", smaller)
    lists = every.groupBy("key").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.max("first").alias("met"), F.min_by("root", F.xxhash64("node")).alias("lead"), F.count("*").alias("n")
    )
    lists = lists.where("a < b AND met").select("key", "lead", F.ceil(F.col("n") / block).alias("blocks"))
    met = cut(every.join(lists, "key").withColumn("leads", F.col("root") == F.col("lead")).drop("lead"))
    discard(posted)

    def side(rows: DataFrame, k: str, part: Column) -> DataFrame:
        return rows.withColumn("part", part).select("key", "part", F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("root", "size", "at")])

    def pairs(small: DataFrame, large: DataFrame) -> DataFrame:
        x = side(small.where("first"), "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        y = side(large, "y", F.pmod(F.xxhash64("node"), F.col("blocks")))
        fits = (F.col("x_root") != F.col("y_root")) & (F.struct("x_size", "x") < F.struct("y_size", "y")) & (F.col("x_size") >= F.col("y_size") * least - 1e-6)
        left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
        return x.join(y, ["key", "part"]).where(fits & (left >= _alpha(F.col("x_size") + F.col("y_size"), least)))

    both = pairs(met.where("NOT leads"), met).unionByName(pairs(met.where("leads"), met.where("NOT leads")))
    return both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def similar(docs: DataFrame, width: int = WIDTH, least: float = LEAST, coarse: bool = True) -> DataFrame:
    """(id, component) for each row (id, text) of ``docs``: components of the links between all rows
    whose sets of shingles have a Jaccard similarity of at least ``least``.

    With ``coarse``, documents whose fingerprints are linked are candidates too, beside those of a band.
    """
    rows = stored(_sketched(docs, width))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("id"), F.min("fp").alias("fp")))
    keyed = rows.select(F.explode("keys").alias("key"), "node")
    if coarse:
        near = components(links(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("root").alias("key"))
        keyed = keyed.unionByName(nodes.join(near, "fp", "left").select(F.coalesce("key", "fp").alias("key"), "node"))
    several = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    met = stored(keyed.join(several, "key").distinct())
    asked = cut(met.select("node").distinct())
    sizes = cut(rows.where(F.size("bits") > 0).join(asked, "node", "left_semi").dropDuplicates(["node"]).select("node", "size", "bits"))
    have = stored(_held(docs, nodes.join(asked, "node").select("id"), width, asked.count()))
    tidy(docs.sparkSession)

    def side(at: DataFrame, k: str) -> DataFrame:
        return at.join(sizes.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("bits").alias(f"{k}_bits")), k)

    def grouped(linked: DataFrame | None, star: int) -> DataFrame:
        """(key, node, root, hub, lead, n) in the keys of ``n`` nodes that are not one group yet; ``lead`` is the group of the ``hub``."""
        own = met.select("key", "node", F.col("node").alias("root")) if linked is None else met.join(components(linked), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        first = F.xxhash64("node", F.lit(star))
        leads = own.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min_by("node", first).alias("hub"), F.min_by("root", first).alias("lead"), F.count("*").alias("n"))
        return cut(own.join(leads.where("a < b").drop("a", "b"), "key"))

    close = _alike(F.col("u_bits"), F.col("v_bits"), F.col("u_size"), F.col("v_size"), least)

    def more(linked: DataFrame | None, pairs: DataFrame) -> DataFrame:
        found = _verified(cut(pairs), have, least)
        return cut(found if linked is None else linked.unionByName(found))

    linked, known, own = None, 0, grouped(None, 0)
    for star in range(STARS):
        pairs = own.where("root <> lead").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
        linked = more(linked, side(side(pairs, "u"), "v").where(close).select("u", "v"))
        tidy(docs.sparkSession)
        own = grouped(linked, star + 1)
        known, before = linked.count(), known
        if known == before or own.where(F.col("n") > LIST).isEmpty():
            break
    short = own.where(F.col("n") <= LIST)
    x, y = (
        side(short.where(of).withColumnRenamed("node", k), k).select("key", k, f"{k}_size", f"{k}_bits", F.col("root").alias(f"{k}_root"), (F.col("root") == F.col("lead")).alias(f"{k}_leads"))
        for k, of in (("u", "true"), ("v", "root <> lead"))
    )
    apart = (F.col("u_root") != F.col("v_root")) & (F.col("u_leads") | (F.col("u") < F.col("v")))
    others = x.withColumnRenamed("key", "other").join(y, (F.col("other") == F.col("key")) & apart & close).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    linked = more(linked, others.distinct())
    # groups as they were: what short keys have linked since is met again, and found again
    long = cut(own.where(F.col("n") > LIST).select("node", "root").distinct())
    if not long.isEmpty():
        linked = more(linked, side(side(prefix_pairs(have.join(long, "node", "left_semi"), long, least), "u"), "v").where(close).select("u", "v"))
    roots = cut(components(linked))
    named = cut(rows.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("component")))
    for done in (rows, met, have):
        discard(done)
    tidy(docs.sparkSession)
    return named


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar documents, that of the smallest id, with its columns as they are."""
    name = F.xxhash64(F.lit("row"), *[F.col(f"`{c}`") for c in docs.columns])
    slim = docs.select(name.alias("id"), F.col(text_col).alias("text"), F.col(id_col).alias("own"))
    groups = similar(slim).distinct()
    order = F.struct(F.col("own").isNull(), F.col("own"), F.col("id").alias("id"))
    first = groups.join(slim.select("id", "own"), "id").groupBy("component").agg(F.min(order).alias("first"))
    chosen = cut(first.select(F.col("first.id").alias("name")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), name.alias("name"))
    # rows that repeat whole have one name: one of them stays
    return whole.join(chosen, "name").dropDuplicates(["name"]).select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``."""
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
