"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

1. Targets.  Sources share ``share`` times the corpus by weight; a target stops at ``most`` times its
   source's size and the excess goes to the others by weight.  That is water filling: with sources in
   order of cap per weight, the level is the first at which the next source is not above its cap.
2. Schedule.  Slot n of N takes the point frac((n + 1) / golden ratio).  Mapped through the sources'
   cumulative targets, the points give each source its share of slots with low discrepancy at every
   stretch of the schedule.  A source too small to be met by a point has one slot at the end.
3. Blocks.  Each source's documents, in an order shuffled by hash, form a circular stream of words, of
   which the source's rounded target is cut into as many equal blocks (to one word) as it has slots, so
   that every source is taken to its target at every size.  The r-th slot of a source takes its r-th
   block; the stream is taken again from its start when it has ended, up to ``most`` times.

A document's ``taken`` is the number of its words in the blocks that slots take.  Positions come from
running sums in two levels (within hash buckets of a source, whose number follows the rows, and over its
buckets), so a source that holds a third of all rows is spread over many groups; rows that repeat whole
are one item there.  Blocks grow with the corpus; their number, and so the schedule, does not.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of
size 0 are taken 0 times; rows that repeat are mixed as separate documents; a very long text is cut by
blocks like any other; ties of the hash go by id and size; the empty table gives an empty mix; other columns are ignored.  Reruns agree: nothing depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import cut, word_count

GOLDEN = 0.6180339887498949
#: Hash buckets of each source's shuffled order, at least; copies of a row that are dealt together.
BUCKETS, COPIES = 1024, 1024
#: Slots of the schedule for each source, on average.
SLOTS = 4096
# The contract's repeating weights, its share of the corpus and the most passes.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def row_key(id_col: str, source_col: str, text_col: str) -> Column:
    """A hash of the row, by which its source's stream is shuffled."""
    return F.xxhash64(F.lit("shuffle"), F.col(id_col), F.col(source_col), F.coalesce(F.col(text_col), F.lit("")))


def sized(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The slim rows (doc_id, source, size, row) that a mix works on."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        row_key(id_col, source_col, text_col).alias("row"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """One row for each source: its rank, size, weight and target, its interval of the cumulative
    targets, and the words of a slot on average (the total over ``slots`` slots a source).

    The windows run over sources, after all rows of a source have become one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    all_of = Window.partitionBy()
    s = s.withColumn("words", F.sum("source_size").over(all_of) * F.lit(float(share))).withColumn("heavy", F.sum("weight").over(all_of))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    s = s.withColumn("cap", cap)
    s = s.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (F.col("heavy") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
    # the first source that stays below its cap sets the level for itself and all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level").alias("at")))).over(all_of)["at"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "source", "rank", "weight", "source_size", "cap", "target", F.sum("target").over(all_of).alias("total"), F.count("*").over(all_of).alias("sources"),
        F.coalesce(F.sum("target").over(before), F.lit(0.0)).alias("low"), F.sum("target").over(upto).alias("high"),
    )
    return s.withColumn("words", F.greatest(F.ceil(F.col("total") / (F.col("sources") * slots)), F.lit(1)).cast("long"))


def schedule(of: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row for each slot: (slot, source rank, block, words), from the rows of ``targets``.

    ``block`` is the rank of the slot among its source's slots; ``words`` is the words its block holds.
    Points meet their source's interval of the cumulative targets by way of equal cells of the unit
    interval, an equi-join, so no pair of a slot and a source is formed outside one cell.
    """
    count = F.ceil(F.col("total") / F.col("words")).cast("long")
    cells = F.greatest(F.ceil(count / 8), F.lit(1)).cast("long")
    base = of.where("total > 0").select("rank", "target", "total", "low", "high", "sources", count.alias("count"), cells.alias("cells"))
    share = F.ceil(F.col("count") / F.col("sources")).cast("long")
    points = base.withColumn("slot", F.explode(F.sequence(F.col("rank") * share, (F.col("rank") + 1) * share - 1))).where("slot < count")
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    points = points.select("slot", "cells", (point - F.floor(point)).alias("point")).withColumn("cell", F.floor(F.col("point") * F.col("cells")))
    last = F.max("rank").over(Window.partitionBy())
    spans = base.where("target > 0").select(
        "rank", "cells", (F.col("low") / F.col("total")).alias("low"),
        F.when(F.col("rank") == last, F.lit(2.0)).otherwise(F.col("high") / F.col("total")).alias("high"),
    )
    end = F.least(F.floor(F.col("high") * F.col("cells")), F.col("cells"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * F.col("cells")), end)))
    taken = points.join(spans.drop("cells"), "cell").where("point >= low AND point < high")
    # ranks within a source in two levels, as for the documents
    run = F.floor(F.col("slot") / slots)
    in_run = Window.partitionBy("rank", "run").orderBy("slot")
    placed = taken.select("slot", "rank", run.alias("run")).withColumn("at", F.row_number().over(in_run) - 1)
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("rank", "run").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    met = placed.join(runs.select("rank", "run", "before"), ["rank", "run"]).select("slot", "rank", (F.col("before") + F.col("at")).alias("block"))
    held = base.select("rank", "target", "count").join(runs.groupBy("rank").agg(F.sum("count").alias("held")), "rank", "left")
    at_end = F.col("count") + F.row_number().over(Window.orderBy("rank")) - 1
    missed = held.where(F.col("held").isNull() & (whole_target() > 0)).select(at_end.alias("slot"), "rank", F.lit(0).cast("long").alias("block"))
    held = held.select("rank", whole_target().alias("goal"), F.coalesce("held", F.lit(1)).alias("held"))
    return met.unionByName(missed).join(held, "rank").select("slot", "rank", "block", (block_end(F.col("block")) - block_start(F.col("block"))).alias("words"))


def whole_target() -> Column:
    """A source's target in whole words."""
    return F.round("target").cast("long")


def block_start(block: Column) -> Column:
    """Where a block starts in the ``goal`` words that ``held`` blocks share: the first ones have a word more."""
    return block * F.expr("goal div held") + F.least(block, F.col("goal") % F.col("held"))


def block_end(block: Column) -> Column:
    return block_start(block + 1)


def block_of(place: Column) -> Column:
    """The block of a word's place below ``goal``."""
    small, more = F.expr("goal div held"), F.col("goal") % F.col("held")
    head = more * (small + 1)
    return F.when(place < head, F.floor(place / (small + 1))).otherwise(more + F.floor((place - head) / F.greatest(small, F.lit(1))))


def streams(sizes: DataFrame, of: DataFrame, copies: int = COPIES) -> DataFrame:
    """Each document with its source's row (with its ``goal`` and ``held`` blocks) and its words' place [start, start + size) in the source's stream.

    Rows that repeat whole stand one after another: they are one item in the running sums, and its
    copies are told apart afterwards, in runs of ``copies`` dealt evenly, so no window holds them.
    """
    items = sizes.groupBy("source", "row", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n"))
    buckets = F.pmod("row", F.lit(sized_buckets(sizes.count())))
    rows = items.withColumn("bucket", buckets)
    order = Window.partitionBy("source", "bucket").orderBy("row", "doc_id", "size")
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("start", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = items.groupBy("source", buckets.alias("bucket")).agg(F.sum("words").alias("filled"))
    filled = filled.withColumn("before", F.coalesce(F.sum("filled").over(before), F.lit(0)))
    same = lambda a, b: a.eqNullSafe(b)
    filled = filled.join(of, same(filled["source"], of["source"])).drop(of["source"])
    joined = rows.join(filled, same(rows["source"], filled["source"]) & (rows["bucket"] == filled["bucket"]))
    slim = joined.select(
        "doc_id", "row", "size", rows["bucket"], "at", "n", "rank", "source_size", "target", "goal", "held", (F.col("start") + F.col("before")).alias("first"),
    )
    whole = [c for c in slim.columns if c not in ("n", "first")]
    start = (F.col("first") + F.col("copy") * F.col("size")).alias("start")
    single = slim.where("n = 1").withColumn("copy", F.lit(0).cast("long"))
    many = slim.where("n > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies))))
    # a given number of partitions, which are not merged for being small before the copies are made
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(parts, "rank", "bucket", "at", "run").withColumn("copy", F.explode(F.sequence(F.col("run") * copies, F.least(F.col("n"), (F.col("run") + 1) * copies) - 1)))
    return single.select(*whole, "copy", start).unionByName(many.select(*whole, "copy", start))


def sized_buckets(rows: int) -> int:
    """Hash buckets of each source's order: a power of two, of some 4,096 rows each in a source that holds all."""
    return max(BUCKETS, 1 << max(0, rows // 4096).bit_length())


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken) for each row of ``docs``."""
    sizes = cut(sized(docs, source_col, text_col, id_col))
    of = cut(targets(sizes, most=most))
    slots = cut(schedule(of).select("rank", "block"))  # used twice: else both plans below hold the whole schedule
    goals = of.join(slots.groupBy("rank").agg(F.count("*").alias("held")), "rank", "left").withColumn("goal", whole_target())
    placed = cut(streams(sizes, goals))
    pieces = placed.where("size > 0 AND held > 0")
    pieces = pieces.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(most)])))
    pieces = pieces.withColumn("low", F.col("start") + F.col("pass") * F.col("source_size")).where("low < goal")
    pieces = pieces.withColumn("high", F.least(F.col("low") + F.col("size"), "goal"))
    pieces = pieces.withColumn("block", F.explode(F.sequence(block_of(F.col("low")), block_of(F.col("high") - 1))))
    held = F.least("high", block_end(F.col("block"))) - F.greatest("low", block_start(F.col("block")))
    pieces = pieces.select("rank", "bucket", "at", "copy", "block", held.alias("held"))
    taken = pieces.join(slots, ["rank", "block"]).groupBy("rank", "bucket", "at", "copy").agg(F.sum("held").alias("taken"))
    return placed.join(taken, ["rank", "bucket", "at", "copy"], "left").select("doc_id", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of ``docs``."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, to the nearest whole document.

    Rows with the same id, source and text are taken equally often.
    """
    counts = mix(docs, id_col, source_col, text_col).groupBy("row").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    counts = counts.where("size > 0").select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(id_col, source_col, text_col).alias("row"))
    return whole.join(counts, "row").select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
