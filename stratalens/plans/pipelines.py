"""Composed pipelines: ingest, embed, index, ask, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.config import Settings
from stratalens.operators import answer, chunking, embedding, evaluation, index, search, shared, trace
from stratalens.sources import artifacts, docx, tables
from stratalens.sources.files import Exported
from stratalens.sources.tables import Table


def ingest(spark: SparkSession, source: str, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, units) of a folder of DOCX files."""
    docs = chunking.normalized(docx.read(docx.listed(spark, source)))
    return docs, chunking.retrieval_units(docs, size)


def embed_folder(
    spark: SparkSession, source: str, cache: str, provider: embedding.Provider, document: str | None = None, kind: str | None = None,
    limit: int | None = None, settings: Settings = Settings(),
) -> DataFrame:
    """Records of a folder's units (of one document, kind or the first ``limit`` if asked), embedded through the cache."""
    docs = chunking.normalized(docx.read(docx.listed(spark, source, document)))
    records = embedding.of_kind(embedding.contract(chunking.retrieval_units(docs), settings=settings), kind)
    records = embedding.first_units(records, limit) if limit is not None else records
    known = artifacts.read_cache(spark, cache)
    return embedding.embed(records, provider, embedding.last_wins(known, ["file_path", "position"]))


def ingest_tables(spark: SparkSession, source: str, root: str, size: int = 5) -> None:
    """The tables of documents, chunks and units below ``root`` from a folder of DOCX files: its documents are replaced, others stay."""
    docs = Table(spark, root, tables.DOCUMENTS)
    fresh = shared.kept(chunking.normalized(docx.read(docx.listed(spark, source))))
    docs.write(fresh)
    names = fresh.select("document_name")
    docs = docs.read().join(names.distinct(), "document_name", "left_semi")
    Table(spark, root, tables.CHUNKS).write(chunking.chunk_paragraphs(docs, size), names)
    Table(spark, root, tables.UNITS).write(chunking.retrieval_units(docs, size), names)


def embed_tables(spark: SparkSession, root: str, provider: embedding.Provider, settings: Settings = Settings()) -> DataFrame:
    """The tables of records and their summaries from that of units; vectors of known cache keys are not made again.  Returns the summaries written."""
    held = Table(spark, root, tables.RECORDS)
    records = embedding.contract(Table(spark, root, tables.UNITS).read(), settings=settings)
    known = embedding.last_wins(embedding.usable(held.read()), ["document_name", "unit_index"]) if held.exists() else None
    records = shared.kept(embedding.embed(records, provider, known))
    summary = embedding.run_summary(records)
    held.write(records)
    Table(spark, root, tables.SUMMARIES).write(summary)
    return Table(spark, root, tables.SUMMARIES).read()


def index_tables(spark: SparkSession, root: str, collection: index.Collection) -> DataFrame:
    """Upsert the usable records of the table; returns the summary."""
    collection.ensure()
    return collection.upsert(index.batch_from_cache(Table(spark, root, tables.RECORDS).read(), ["document_name", "unit_index"]))


#: Files of a batch of ``follow``.
AT_ONCE = 10_000


def follow(
    spark: SparkSession, source: str, root: str, checkpoint: str, provider: embedding.Provider, collection: index.Collection, settings: Settings = Settings(),
    size: int = 5, at_once: int = AT_ONCE,
) -> int:
    """Bring the files that are new in a folder of DOCX files into the tables below ``root`` and into the collection; returns the number of batches that had some.

    A checkpointed file stream that ends when it has seen all: a file is read once by its path, so a run over an unchanged
    folder opens none, and one over a few new files parses, embeds (what no record has) and upserts these only.  A file that changes
    under its name is not seen; ``ingest_tables`` reads it.  A batch that failed is done again by the next run, and replaces its own
    documents and points.  Records of all known keys are read for each batch.
    """
    collection.ensure()
    done = []

    def batch(new: DataFrame, number: int) -> None:
        made = shared.kept(chunking.normalized(docx.read(new)))
        docs = spark.read.schema(made.schema).parquet(made.kept_at)  # in the caller's session, which plans adaptively
        if not docs.isEmpty():
            names, units = docs.select("document_name"), chunking.retrieval_units(docs, size)
            held = Table(spark, root, tables.RECORDS)
            known = embedding.last_wins(embedding.usable(held.read()), ["document_name", "unit_index"]) if held.exists() else None
            records = shared.kept(embedding.embed(embedding.contract(units, settings=settings), provider, known))
            for name, rows in ((tables.DOCUMENTS, docs), (tables.CHUNKS, chunking.chunk_paragraphs(docs, size)), (tables.UNITS, units), (tables.RECORDS, records), (tables.SUMMARIES, embedding.run_summary(records))):
                Table(spark, root, name).write(rows, names)
            # a point is of all records of its key, as in ``index_tables``
            own = held.read().join(records.select("cache_key").distinct(), "cache_key", "left_semi")
            collection.upsert(index.batch_from_cache(own, ["document_name", "unit_index"]))
            shared.discard(records)
            done.append(number)
        shared.discard(made)

    stream = docx.arriving(spark, source, at_once).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return len(done)


def index_cache(spark: SparkSession, cache: str, collection: index.Collection) -> DataFrame:
    """Upsert all cached records; returns the summary."""
    collection.ensure()
    return collection.upsert(index.batch_from_cache(artifacts.read_cache(spark, cache), ["file_path", "position"]))


def hits(collection: index.Collection, questions: DataFrame, provider: embedding.Provider, limit: int = 5, release_label: str | None = None, source_kind: str | None = None) -> DataFrame:
    """Best points for questions (query_id, query, filters): from the collection's cells where they are laid out, else from
    all points of the release and kind."""
    laid = collection.cells()
    if laid is not None:
        for field, value in (("release_label", release_label), ("source_kind", source_kind)):
            if value is not None:  # as where only such points are read: a question that asks for another value finds nothing
                own = F.col(field) if field in questions.columns else F.lit(None)
                questions = questions.where(own.isNull() | (own == value)).withColumn(field, F.lit(value))
        return laid.search_many(embedding.embed_query(questions, provider), limit)
    return search.search_texts(collection.read(release_label, source_kind), questions, provider, limit, few=True)


def ask(
    collection: index.Collection, questions: DataFrame, provider: embedding.Provider, chat: answer.ChatProvider | None = None, limit: int = 5,
    settings: Settings = Settings(), release_label: str | None = None, source_kind: str | None = None, **rules,
) -> tuple[DataFrame, DataFrame]:
    """(answers, hits) of questions (query_id, query, filters); ``release_label`` and ``source_kind`` prune what is read."""
    found = hits(collection, questions, provider, limit, release_label, source_kind)
    return answer.grounded_answers(questions, found, chat, settings, **rules), found


def evaluate(collection: index.Collection, cases: DataFrame, provider: embedding.Provider, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, cases) of evaluation cases against the collection."""
    asked = cases.select(F.col("case_id").alias("query_id"), "query", "filters.*")
    found = hits(collection, asked, provider, limit).withColumnRenamed("query_id", "case_id")
    done = evaluation.evaluated(cases, found)
    return evaluation.report(done), done


def traced(answers: DataFrame, hits: DataFrame, directory: str, request_id: str | None = None, filters: dict | None = None) -> Exported:
    rows = trace.traces(answers, hits, request_id, filters)
    return artifacts.export(rows, directory, "request_id", ".json")
