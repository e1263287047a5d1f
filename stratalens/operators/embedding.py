"""Embedding records: contract, cache, providers, metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.config import Settings
from stratalens.functions.hashing import cache_key, content_hash
from stratalens.functions.text import strip
from stratalens.operators import shared

PENDING, EMBEDDED, CACHED = "pending", "embedded", "cached"
KINDS = ("paragraph", "table")
NO_VECTOR = "array<double>"


class Provider(Protocol):
    """Adds the embedding of column ``text`` as column ``vector``; rows stay as they are otherwise.

    A provider may also have ``fill(rows, text, vector, missing)``, which embeds only the rows where the
    boolean column ``missing`` holds; the others keep their vector.
    """

    def embed(self, rows: DataFrame, text: str, vector: str) -> DataFrame: ...


class HashProvider:
    """Deterministic offline embedding: counts of lower-case words in hash buckets, of unit length."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def slots(self, text: Column) -> Column:
        """The hash slot of each word."""
        words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
        return F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 2), 16, 10).cast("int") % self.size)

    def embed(self, rows: DataFrame, text: str, vector: str) -> DataFrame:
        return rows.withColumn(vector, self.of(F.col(text)))

    def fill(self, rows: DataFrame, text: str, vector: str, missing: str) -> DataFrame:
        return rows.withColumn(vector, F.when(F.col(missing), self.of(F.col(text))).otherwise(F.col(vector)))

    def of(self, text: Column) -> Column:
        each = F.sequence(F.lit(0), F.lit(self.size - 1))

        def counts(slots: Column) -> Column:
            return F.transform(each, lambda i: (F.size(slots) - F.size(F.array_remove(slots, i))).cast("double"))

        return unit(bound(self.slots(text), counts))


#: Texts whose vectors are written down together in a ledger.
GROUP = 64


def _client(connect: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
    """A client that fails if it brings another number of vectors than texts."""
    client = connect()

    def checked(texts: list[str]) -> list[list[float]]:
        made = client(texts) if texts else []
        if len(made) != len(texts):
            raise RuntimeError(f"Embedding response count mismatch: expected {len(texts)}, got {len(made)}")
        return [[float(v) for v in m] for m in made]

    return checked


class ClientProvider:
    """A remote model: ``connect`` makes a client on the executor, which embeds a list of texts at a time.

    With a ``ledger`` (of responses by key, see ``sources.ledger``) a text is sent once, whatever is run again: its
    rows are written to the shared folder, and what they lack is asked for, when the vectors are put in, not when they are read.
    """

    def __init__(self, connect: Callable[[], Callable[[list[str]], list[list[float]]]], ledger=None) -> None:
        self.connect, self.ledger = connect, ledger

    def embed(self, rows: DataFrame, text: str, vector: str) -> DataFrame:
        return self.fill(rows, text, vector, None)

    def fill(self, rows: DataFrame, text: str, vector: str, missing: str | None) -> DataFrame:
        if self.ledger is not None:
            return self._once(rows, text, vector, missing)
        connect, schema = self.connect, [f for f in rows.schema.fields if f.name != vector]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = _client(connect)
            for b in batches:
                own = b[missing].to_numpy(bool) if missing else np.ones(len(b), bool)
                fresh = iter(client(b[text][own].tolist()))
                old = b[vector] if missing else [None] * len(b)
                yield b.assign(**{vector: pd.Series([next(fresh) if new else kept for new, kept in zip(own, old)], dtype=object, index=b.index)})

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        return (rows if missing else rows.drop(vector)).mapInPandas(run, f"{ddl}, `{vector}` {NO_VECTOR}")

    def _once(self, rows: DataFrame, text: str, vector: str, missing: str | None) -> DataFrame:
        connect, ledger = self.connect, self.ledger

        def asking() -> Callable[[list[str]], list[str]]:
            client = _client(connect)
            return lambda texts: [json.dumps(v) for v in client(texts)]

        names = [c for c in rows.columns if c != vector]
        rows = shared.kept(rows if missing else rows.drop(vector))  # what is asked for is what gets the responses
        lacking = rows.where(missing) if missing else rows
        lacking = lacking.select(*names, ledger.key(F.col(text)).alias("_key"))
        answers = ledger.answered(lacking.select(F.col("_key").alias("key"), F.col(text).alias("request")), asking, GROUP)
        made = F.coalesce(F.from_json("response", NO_VECTOR), F.raise_error(F.lit("The ledger has lost a response")).cast(NO_VECTOR))
        done = lacking.join(answers.withColumnRenamed("key", "_key"), "_key", "left").select(*names, made.alias(vector))
        return done.unionByName(rows.where(~F.col(missing)).select(*names, vector)) if missing else done


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def unit(vector: Column) -> Column:
    """The vector at unit length; null if it is zero."""
    def length(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))

    def scaled(v: Column) -> Column:
        return bound(length(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))

    return bound(vector, scaled)


def contract(units: DataFrame, model: str | None = None, version: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """Units as pending records with content hash and cache key."""
    version, model = version or settings.artifact_version, model or settings.embedding_model
    out = units.withColumn("content_hash", content_hash(F.col("text"))).withColumn("artifact_version", F.lit(version)).withColumn("embedding_model", F.lit(model))
    return out.withColumns({
        "cache_key": cache_key(F.col("content_hash"), F.col("embedding_model"), F.col("artifact_version")),
        "embedding_status": F.lit(PENDING), "vector": F.lit(None).cast(NO_VECTOR),
    })


def usable(records: DataFrame) -> DataFrame:
    """Records that hold a finished vector."""
    return records.where(F.col("embedding_status").isin(EMBEDDED, CACHED) & F.col("vector").isNotNull())


def last_wins(records: DataFrame, order: list[str], check: bool = True) -> DataFrame:
    """One record for each cache key, the last in ``order``; fails if a key has different vectors."""
    rest = [c for c in records.columns if c != "cache_key"]
    key = F.struct(*order)
    out = records.groupBy("cache_key").agg(F.max_by(F.struct(*rest), key).alias("r"), (F.min("vector") != F.max("vector")).alias("conflict"))
    if check:
        fail = F.raise_error(F.concat(F.lit("Conflicting cached vectors for cache_key "), F.col("cache_key"))).cast(NO_VECTOR)
        out = out.withColumn("v", F.when(F.coalesce("conflict", F.lit(False)), fail).otherwise(F.col("r.vector")))
        return out.select("cache_key", *[F.col("v").alias(c) if c == "vector" else F.col(f"r.{c}").alias(c) for c in rest])
    return out.select("cache_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def conflicts(records: DataFrame) -> DataFrame:
    """(cache_key, vectors, has_conflict): how many different vectors each key has."""
    return records.groupBy("cache_key").agg(F.countDistinct("vector").alias("vectors")).withColumn("has_conflict", F.col("vectors") > 1)


def lookup(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(F.col("cache_key") == key)


def with_cache(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records with their cached vector and status; cache holds one row for each key, own metadata stays."""
    hits = cache.select("cache_key", F.col("vector").alias("_cached"))
    out = records.join(hits, "cache_key", "left")
    found = F.col("_cached").isNotNull()
    return out.withColumns({"vector": F.col("_cached"), "embedding_status": F.when(found, CACHED).otherwise(F.col("embedding_status"))}).drop("_cached").select(*records.columns)


def embed(records: DataFrame, provider: Provider, cache: DataFrame | None = None) -> DataFrame:
    """All records with vectors: cached ones from ``cache``, the others from the provider only."""
    if cache is None:
        return provider.embed(records, "text", "vector").withColumn("embedding_status", F.lit(EMBEDDED)).select(*records.columns)
    looked = with_cache(records, cache).withColumn("_miss", F.col("embedding_status") != CACHED)
    if hasattr(provider, "fill"):  # one pass: neither the records nor the join are evaluated twice
        made = provider.fill(looked, "text", "vector", "_miss")
    else:
        made = looked.where("NOT _miss").unionByName(provider.embed(looked.where("_miss"), "text", "vector").select(*looked.columns))
    return made.withColumn("embedding_status", F.when(F.col("_miss"), EMBEDDED).otherwise(F.col("embedding_status"))).select(*records.columns)


def embed_query(queries: DataFrame, provider: Provider, text: str = "query", vector: str = "query_vector") -> DataFrame:
    """Queries with their vectors; the text is stripped first and must not be empty."""
    bare = strip(F.col(text))
    checked = F.when(F.coalesce(bare, F.lit("")) == "", F.raise_error(F.lit("query_text must not be empty")).cast("string")).otherwise(bare)
    return provider.embed(queries.withColumn("_bare", checked), "_bare", vector).drop("_bare")


def metrics(records: DataFrame, by: list[str] | None = None, *more: Column) -> DataFrame:
    """Counts of records, hits, embedded and misses, the hit rate (0 of no records), and ``more`` aggregates."""
    status = lambda s: F.count_if(F.col("embedding_status") == s)
    total = F.count("*")
    return records.groupBy(*(by or [])).agg(
        total.alias("total_records"), status(CACHED).alias("cached_count"), status(EMBEDDED).alias("embedded_count"),
        F.count_if(F.col("embedding_status") != CACHED).alias("cache_miss_count"),
        F.coalesce(F.try_divide(status(CACHED).cast("double"), total.cast("double")), F.lit(0.0)).alias("cache_hit_rate"), *more,
    )


def run_summary(records: DataFrame) -> DataFrame:
    """Metrics of each document with the distinct models and versions, sorted."""
    sets = {"embedding_models": "embedding_model", "artifact_versions": "artifact_version"}
    return metrics(records, ["document_name"], *[F.sort_array(F.collect_set(c)).alias(name) for name, c in sets.items()])


def first_units(records: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records in order of unit index."""
    if limit <= 0:
        raise ValueError("limit must be greater than 0")
    return records.orderBy("unit_index", "unit_id").limit(limit)


def of_kind(records: DataFrame, kind: str | None) -> DataFrame:
    if kind is None:
        return records
    if kind not in KINDS:
        raise ValueError(f"Unsupported source_kind: {kind}")
    return records.where(F.col("source_kind") == kind)
