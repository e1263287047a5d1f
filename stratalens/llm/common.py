"""Shared pieces of the training-data operators: lineage cuts, components, native span finding."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a graph that are put together by one task; of a larger one they are dealt out.
FEW = 1 << 18
#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this machine (tests, local use) a folder of this machine is set.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a cut where columns are read apart."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` has written, once nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects garbage, which may be long after the disk is needed.
    """
    gc.collect()
    spark._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    # a letter for each word: a count of matches would make a list of all words
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*+\S++", "x")
    return F.length(F.rtrim(letters, F.lit(" \t\n\x0b\f\r"))).cast("long")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Connected components of the long edges (u, v): one row (node, root) for each node that is not
    the smallest of its component.

    Alternates the large-star and small-star steps until no edge changes.  A hub's rows meet only in
    aggregates with map-side combine and in joins that adaptive execution can split, never in one
    task's memory; each round is cut, so a lost executor does not restart the loop.  A round of at most ``few`` edges, whatever the
    graph was before, is one task's without any exchange, instead of hundreds of tasks and files for a few rows each.
    """
    at = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(at)
    while mark[0]:
        alone = mark[0] <= few
        put = (lambda df: df.coalesce(1)) if alone else (lambda df: df)
        beside = (lambda df: df.hint("merge")) if alone else (lambda df: df)  # a broadcast would be a job of its own
        both = put(at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(beside(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(beside(low), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = cut(put(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct())
        tidy(at.sparkSession)  # of many small shuffles, only the last round's are needed
        mark, before = _mark(at), mark
        if mark == before:
            break
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


# --- native span finding -------------------------------------------------------------------------


#: Matches placed by one pass; longer lists of matches are placed in chunks of so many.
CHUNK = 512
#: Code points of context kept before a match.
CONTEXT = 24


def match_spans(text: Column, pattern: str, kind: str, groups: tuple[int, ...] = (0,)) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,kind,end,before,g0,...>>.

    Offsets count code points, the end is exclusive; ``before`` holds the text just before the match
    (up to the last match), ``g<i>`` the i-th asked-for group.  Built
    on the pieces between matches, so no Python runs: a match starts where the pieces and matches
    before it end.  The pattern must never match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sized = F.arrays_zip(
        F.transform(gaps, lambda g: F.length(g)).alias("gap"),
        F.transform(gaps, lambda g: F.substring(g, -CONTEXT, CONTEXT)).alias("before"),
        F.transform(found, lambda m: F.length(m)).alias("len"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups],
    )
    sized = F.filter(sized, lambda x: x["len"].isNotNull())
    fields = ",".join(["start:int", "kind:string", "end:int", "before:string", *[f"g{g}:string" for g in groups]])

    def place(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end"),
            x["before"].alias("before"), *[x[f"g{g}"].alias(f"g{g}") for g in groups],
        )
        return F.struct((start + x["len"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def chunk(s: Column, c: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.array().cast(f"array<struct<{fields}>>").alias("spans"))
        return F.aggregate(F.slice(s, c * CHUNK + 1, F.lit(CHUNK)), start, place, lambda a: a["spans"])

    def every(s: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(s) - 1) / CHUNK).cast("int"), F.lit(0)))
        sums = F.transform(chunks, lambda c: F.aggregate(F.slice(s, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
        # where each chunk starts: one running sum over the chunks
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.flatten(F.transform(F.array(starts), lambda at: F.transform(chunks, lambda c: chunk(s, c, F.get(at, c))))))

    return F.transform(F.array(sized), every)[0]


def digest_columns(base: Column, every: Column) -> list[Column]:
    """base_sha256 and spans from arrays of (start, kind, end) that are already in order."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return [F.sha2(told(base), 256).alias("base_sha256"), told(every).alias("spans")]
