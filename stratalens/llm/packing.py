"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin is cut: its full pieces fill bins of their own, its rest is packed.  Two
pieces conflict if they are of the same duplicate cluster (equal texts up to case and white space, or,
where ``clusters`` are given, near-duplicates: components of texts linked at similarity 0.8 of five-word
shingles), and a bin takes at most ``per_source`` pieces of one source.  Each piece goes to the tightest bin that
holds it without a conflict: open bins are kept by residual, and each set of bins (of a residual, with
a cluster, with a source at its limit) is a bitmap, so the search steps from one residual to its
successor and masks out the bins in conflict until a bin is left.  Only if none is left is a new one
opened.

Full pieces need no search and no shard: columns name their bins.  The others, one of a document at most, are
dealt to shards by hash, ``SHARD`` to each on average, and shards are packed apart.  So no
source or cluster, however large, meets in one task; a shard's last bins are the only cost.

Defined cases: null text and text without words make one piece of 0 words, which is packed like any
other; a null source is a source of its own; rows that repeat are separate pieces of one cluster, spread over
the shards if they are many; a very long text gives as many full pieces as it needs; ties in size go by hash; the
empty table gives no bins; columns besides the id, text and source columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import cut, discard, stored, word_count
from stratalens.llm.simhash import similar

#: Words that a bin holds, pieces of one source that it takes, pieces of a shard on average.
CAPACITY, PER_SOURCE, SHARD = 2048, 4, 4096
#: Copies of a row that may be dealt to one shard.
REPEATS = 64


class Bins:
    """Open bins of one shard; a set of bins is the bits of an int."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.at = [0] * (capacity + 1)  # bins of each residual
        self.held = 0  # residuals that have bins
        self.clusters: dict = {}  # bins with a piece of the cluster
        self.sources: dict = {}  # per source, bins with at least 1, 2, ... pieces of it

    def place(self, size: int, cluster, source) -> int:
        """Number of the bin that takes the piece."""
        counts = self.sources.setdefault(source, [0] * self.per_source)
        barred = self.clusters.get(cluster, 0) | counts[-1]
        rest = self.held >> size
        need = size
        while rest:
            need += (rest & -rest).bit_length() - 1
            free = self.at[need] & ~barred
            if free:
                which = (free & -free).bit_length() - 1
                self._move(which, need, need - size)
                break
            rest = self.held >> (need + 1)
            need += 1
        else:
            which = len(self.residual)
            self.residual.append(self.capacity - size)
            self._move(which, None, self.capacity - size)
        bit = 1 << which
        self.clusters[cluster] = self.clusters.get(cluster, 0) | bit
        for k in range(self.per_source):
            if not counts[k] & bit:
                counts[k] |= bit
                break
        return which

    def _move(self, which: int, old: int | None, new: int) -> None:
        bit = 1 << which
        if old is not None:
            self.at[old] &= ~bit
            if not self.at[old]:
                self.held &= ~(1 << old)
        self.residual[which] = new
        self.at[new] |= bit
        self.held |= 1 << new


def text_name(text_col: str) -> Column:
    """A hash of the text up to case and white space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def near_clusters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, component) for each text's hash: the near-duplicates that it belongs to.

    Texts equal up to case and white space have equal shingles, so they are of one component already.
    """
    found = similar(docs.select(raw_name(text_col).alias("id"), F.lower(F.col(text_col)).alias("text")), coarse=False)
    return found.groupBy(F.col("id").alias("name")).agg(F.min("component").alias("component"))


def raw_name(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None
) -> DataFrame:
    """(doc_id, piece, start, words, source, cluster, deal, copy) for each piece of each document.

    A text that ``clusters`` (name, component) does not name is a cluster of its own.  ``deal`` is a hash of
    the row, but rows that repeat more than ``REPEATS`` times are dealt one by one; ``copy`` tells rows of one ``deal`` apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        (text_name(text_col) if clusters is None else raw_name(text_col)).alias("cluster"), F.xxhash64(F.lit("deal"), F.col(id_col), F.col(source_col), text).alias("deal"),
    )
    read = slim = stored(slim.withColumn("row", F.monotonically_increasing_id()))  # its numbers stay
    often = slim.groupBy("deal").count().where(F.col("count") > REPEATS).select("deal", F.lit(True).alias("often"))
    slim = slim.join(often, "deal", "left").withColumn("deal", F.when(F.col("often"), F.xxhash64("deal", "row")).otherwise(F.col("deal")))
    # at most REPEATS rows of one deal
    slim = slim.withColumn("copy", F.row_number().over(Window.partitionBy("deal").orderBy("row")) - 1).drop("often", "row")
    if clusters is not None:
        slim = slim.join(clusters.withColumnRenamed("name", "cluster"), "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")
    kept = cut(slim)
    discard(read)
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    slim = kept.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    slim = slim.withColumn("start", F.col("piece") * capacity)
    return slim.select("doc_id", "piece", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity)).cast("long").alias("words"), "source", "cluster", "deal", "copy")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, piece, start, words, source, cluster, bin, slot, residual) for each piece.

    ``start`` counts words of the document, ``slot`` the pieces of the bin in order of placement, and
    ``residual`` is what the closed bin has left.
    """
    # ids pass through pandas as strings, which keep nulls and large numbers as they are
    every = pieces(docs, capacity, id_col, text_col, source_col, clusters)
    kind = dict(every.dtypes)["doc_id"]
    full = F.col("words") == capacity
    shards = max(1, -(-every.where(~full).count() // shard))
    dealt = every.where(~full).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("shard", F.pmod(F.xxhash64("deal", "piece"), F.lit(shards)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "deal", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins = Bins(capacity, per_source)
        sources = pdf["source"].where(pdf["source"].notna(), None)
        which = [bins.place(int(w), c, s) for w, c, s in zip(pdf["words"], pdf["cluster"], sources)]
        pdf["slot"] = pd.Series(which).groupby(which).cumcount().astype("int32") if which else []
        pdf["residual"] = [bins.residual[b] for b in which]
        pdf["bin"] = [f"{key[0]}-{b}" for b in which]
        return pdf[["doc_id", "piece", "start", "words", "source", "cluster", "bin", "slot", "residual"]]

    schema = "doc_id string, piece long, start long, words long, source string, cluster long, bin string, slot int, residual int"
    packed = dealt.groupBy("shard").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
    name = F.concat_ws("-", F.lit("full"), F.lower(F.hex("deal")), "copy", "piece")
    alone = every.where(full).select(*packed.columns[:6], name.alias("bin"), F.lit(0).alias("slot"), F.lit(0).alias("residual"))
    return packed.unionByName(alone)


def assembled(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", joint: str = "\n\n") -> DataFrame:
    """(bin, text) of each bin: its pieces' words in slot order.  Ids must be unique in ``docs``."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = packed.join(texts, "doc_id").select("bin", "slot", F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("slot", "text")))
    return cut.groupBy("bin").agg(F.array_join(F.transform(parts, lambda p: p["text"]), joint).alias("text"))


def digest(docs: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row for each piece of each document: where it lies and in which bin."""
    return pack(docs, clusters=clusters).select("doc_id", "piece", "start", "words", "bin", "slot", "residual")
