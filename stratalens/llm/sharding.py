"""Contiguous balanced shards from a global prefix sum of sizes, in DataFrame functions only.

1. Order.  Slim rows (no text) are dealt to ranges of the order and sorted there, and kept in the shared
   folder with their range and place.  A random column ends the order, so that rows which are equal in it
   (repeated rows, null ids) are split over ranges like any others.
2. Totals.  Each range's bytes and rows are summed; a running sum over the ranges, one row each, tells
   where every range starts.
3. Places.  Running sums within the ranges, which all run at once, added to the start of the range give each row
   its global offset in bytes and in rows.
4. Cuts.  The total is cut at equal targets (to one byte); a row belongs to the shard that its middle byte
   lies in, so shards follow the order and each is off its target by less than a row at either end.
   The slot is the row's place less that of the shard's first row.

Only integers are summed, so reruns agree but for rows that are equal in the whole order, of which any
may stand first.  Ranges grow with the rows (``ROWS`` each on average); no range, shard or copy is one task's alone.

Defined cases: null text is of size 1, for its end; null ids come first; repeated rows are separate rows
that follow one another; equal texts stay together only if the order says so (``order`` may start with a
hash of the text); a row larger than a target leaves shards beside it empty; of fewer rows than
shards some are empty; the empty table has no rows; other columns are kept by ``assigned`` and ignored by ``digest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import discard, stored

#: Shards of the registered query.
SHARDS = 16
#: Rows of a range of the order, on average.
ROWS = 1 << 20


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text and one for its end; a null text has the end only."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def ranged(rows: DataFrame, order: list[str], size: Column, per_range: int = ROWS) -> DataFrame:
    """(row, size, range, at): ``rows`` as structs, sorted; ``at`` grows along the order over all ranges."""
    spark = rows.sparkSession
    kept = stored(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), size.cast("long").alias("size")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // per_range))
    keys = [*[F.col("row").getField(c).asc_nulls_first() for c in order], F.col("deal")]
    dealt = kept.withColumn("deal", F.rand(11)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    out = stored(dealt.select("row", "size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    discard(kept)
    return out


def offsets(placed: DataFrame) -> DataFrame:
    """``placed`` with each row's global ``start`` in bytes and ``place`` in rows, and the ``total`` bytes.

    The windows without a key run over the ranges' totals, one row for each range.
    """
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    upto = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy("at")))
    return own.join(starts, "range").select(
        "row", "size", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("place"), "total",
    )


def shard_of(start: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard in which the row's middle byte lies; the first shards' targets have a byte more where the total can't be cut evenly."""
    div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  of whole numbers
    at = start + div(size, F.lit(2))
    small, more = div(total, F.lit(shards)), total % shards
    head = more * (small + 1)
    return F.when(at < head, div(at, small + 1)).otherwise(more + div(at - head, F.greatest(small, F.lit(1)))).cast("int")


def assigned(rows: DataFrame, order: list[str], size: Column, shards: int = SHARDS, per_range: int = ROWS) -> DataFrame:
    """(row, size, shard, slot): every row of ``rows`` as a struct, its shard of 0 to ``shards`` - 1, and its place there.

    Shards are contiguous in ``order`` and near equal in the sum of ``size``, which is not negative.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    cut = offsets(ranged(rows, order, size, per_range)).withColumn("shard", shard_of(F.col("start"), F.col("size"), F.col("total"), shards))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(F.broadcast(first), "shard").select("row", "size", "shard", (F.col("place") - F.col("first")).alias("slot"))  # a row for each shard


def write_shards(rows: DataFrame, path: str, order: list[str], size: Column, shards: int = SHARDS) -> None:
    """Write the whole rows as Parquet below ``path/shard=N``, each shard sorted by slot within its files."""
    out = assigned(rows, order, size, shards).select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    parts = max(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out.repartitionByRange(parts, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``, by the law of equal bytes in order of ``doc_id`` and text."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), text_bytes(F.col("text")).alias("size"), F.xxhash64(text).alias("tie"))
    return assigned(slim, ["doc_id", "text_crc32", "tie"], F.col("size")).select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
