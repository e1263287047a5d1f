import zlib

import pytest
from brute import SF
from llm_oracle import same
from pyspark.sql import functions as F

from stratalens.llm import queries, sharding

SCHEMA = "doc_id long, text string, source string"


def plain(rows, shards):
    """(doc_id, size, crc, shard, slot) by one running sum on one machine."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    sizes = [len(t.encode()) + 1 for _, t in rows]
    total, at, out, held = sum(sizes), 0, [], {}
    ends = [total // shards * (k + 1) + min(k + 1, total % shards) for k in range(shards)]
    for (i, t), n in zip(rows, sizes):
        shard = next(k for k, e in enumerate(ends) if at + n // 2 < e)
        out.append((i, n, zlib.crc32(t.encode()), shard, held.get(shard, 0)))
        held[shard] = held.get(shard, 0) + 1
        at += n
    return out


def told(df):
    return [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_query_is_one_running_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op11_global_byte_shards(spark, SF)
    assert ordered(told(out)) == ordered(plain([(r.doc_id, r.text) for r in docs.collect()], 16))
    assert [r[0] for r in out.select("law").distinct().collect()] == ["bytes"]
    assert out.where("grown_shard IS NOT NULL").count() == 0
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


@pytest.mark.parametrize("rows", [
    [(1, "a", "s")] * 50 + [(None, None, None)] * 40 + [(None, "x", "s")] * 3 + [(2, "", "s"), (3, "é" * 70_000, "s"), (4, " ", None)],
    [(i, "w" * (i * 37 % 90), "s") for i in range(300)],
    [(1, "one", "s")],
    [(i, None, None) for i in range(5)],
])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "row", "range", "at")})
    assert ordered(told(sharding.digest(docs))) == ordered(plain(rows, 16))


def test_empty(spark):
    assert sharding.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        sharding.assigned(spark.createDataFrame([], SCHEMA), ["doc_id"], F.lit(1), 0)


def test_shards_are_near_equal_and_contiguous_over_many_ranges(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.repeat(F.lit("w"), (F.col("id") % 50).cast("int"))).alias("text"))
    out = sharding.assigned(rows, ["k"], sharding.text_bytes(F.col("text")), 7, per_range=500)
    of = {r.shard: r for r in out.groupBy("shard").agg(F.sum("size").alias("s"), F.min("row.k").alias("a"), F.max("row.k").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()}
    assert sorted(of) == list(range(7))
    assert max(r.s for r in of.values()) - min(r.s for r in of.values()) <= 2 * 51
    assert all(r.n == r.d == r.m + 1 for r in of.values())
    assert all(of[k].b < of[k + 1].a for k in range(6))


def test_repeated_rows_are_split_over_ranges(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.lit("copy").alias("text"))
    parts = sharding.ranged(rows, ["k"], sharding.text_bytes(F.col("text")), per_range=250).groupBy("range").count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 800


def test_order_by_a_hash_of_the_text_keeps_copies_together(spark):
    rows = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 40).cast("string").alias("text")).withColumn("copies", F.xxhash64("text"))
    out = sharding.assigned(rows, ["copies", "k"], sharding.text_bytes(F.col("text")), 4)
    shards = [r.n for r in out.groupBy("row.text").agg(F.countDistinct("shard").alias("n")).collect()]
    assert sum(n > 1 for n in shards) <= 3  # only groups that lie across a cut


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), ["doc_id"], sharding.text_bytes(F.col("text")))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    want = {(r.doc_id, r.shard) for r in sharding.digest(docs).collect()}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == want


def test_same_as_sql(spark):
    same(queries.op11_global_byte_shards(spark, SF), queries.oracle_sql()["op11_global_byte_shards"], SF)
