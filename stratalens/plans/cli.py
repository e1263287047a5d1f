"""Command lines: ``python -m stratalens.plans.cli COMMAND --help`` (or spark-submit)."""

from __future__ import annotations

import argparse
import json
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession

from stratalens.config import Settings, configure_logging, get_logger, load_settings, shown
from stratalens.operators.answer import ChatClient
from stratalens.operators.embedding import ClientProvider, HashProvider, of_kind, run_summary
from stratalens.operators.index import Collection
from stratalens.operators.search import preview
from stratalens.plans import pipelines
from stratalens.sources import artifacts, clients
from stratalens.sources.ledger import Ledger

log = get_logger()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalens", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: str) -> None:
        p = sub.add_parser(name, help=text)
        known = {
            "source": dict(required=True, help="folder of DOCX files"), "out": dict(required=True, help="folder to write to"), "cache": dict(required=True, help="folder of embedding artifacts"),
            "store": dict(required=True, help="folder of the collection"), "query": dict(required=True), "limit": dict(type=int, default=5), "document": dict(), "cases": dict(required=True),
            "source-kind": dict(choices=["paragraph", "table"]) if name == "embed" else dict(), "document-family": dict(), "release-label": dict(),
            "min-top-score": dict(type=float), "units": dict(type=int, default=2), "report": dict(required=True), "trace-dir": dict(),
            "root": dict(required=True, help="folder of the tables"), "tables": dict(action="store_true", help="the folder holds Parquet tables, not JSON files"),
            "cells": dict(type=int, help="also lay the points out in so many cells for pruned search (0: by their number)"),
            "provider": dict(choices=["hash", "remote"], default="hash", help="offline hash vectors and extractive answers, or the models of the settings"),
            "checkpoint": dict(required=True, help="folder that tells which files were read"),
            "ledger": dict(help="folder of the remote models' responses, which are then asked for once (embed: _responses in the cache)"),
        }
        for o in options:
            p.add_argument(f"--{o}", **known[o])

    filters = ("document-family", "release-label", "source-kind")
    command("ingest", "write raw, chunk and unit artifacts, or the tables", "source", "out", "tables")
    command("embed", "embed units through the cache", "source", "cache", "document", "source-kind", "units", "provider", "ledger")
    command("embed-tables", "embed the table of units through that of records", "root", "provider", "ledger")
    command("follow", "bring new files into the tables and the collection", "source", "root", "store", "checkpoint", "provider", "ledger")
    command("index", "upsert the cache into the collection", "cache", "store", "cells", "tables")
    command("search", "best units for a query", "store", "query", "limit", "provider", "ledger", *filters)
    command("answer", "grounded answer for a query", "store", "query", "limit", "min-top-score", "trace-dir", "provider", "ledger", *filters)
    command("evaluate", "run evaluation cases", "store", "cases", "report", "limit", "provider", "ledger")
    command("inspect", "describe the collection", "store")
    command("check-setup", "print settings and whether folders exist", "out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = load_settings()
    configure_logging(settings.log_level)
    spark = SparkSession.builder.appName("stratalens").getOrCreate()
    if getattr(args, "provider", "hash") == "remote":
        if args.command == "embed" and args.ledger is None:
            args.ledger = f"{args.cache.rstrip('/')}/_responses"
        provider = ClientProvider(clients.embeddings(settings), _ledger(spark, args, settings, settings.embedding_model))
    else:
        provider = HashProvider()
        settings = replace(settings, vector_size=provider.size)
    return globals()[f"run_{args.command.replace('-', '_')}"](spark, args, settings, provider) or 0


def _ledger(spark: SparkSession, args, settings: Settings, model: str) -> Ledger | None:
    """The ledger asked for; responses of another model or service are not taken for this one's."""
    return Ledger(spark, args.ledger, f"{settings.base_url} {model}") if args.ledger else None


def _question(spark: SparkSession, args):
    given = {k: getattr(args, k) for k in ("document_family", "release_label", "source_kind")}
    return spark.createDataFrame([("q", args.query, *given.values())], "query_id string, query string, document_family string, release_label string, source_kind string"), given


def _collection(spark: SparkSession, args, settings: Settings) -> Collection:
    return Collection(spark, args.store, settings.collection_name, settings.vector_size)


def run_ingest(spark, args, settings, provider) -> None:
    from stratalens.operators.chunking import chunk_paragraphs

    if args.tables:
        pipelines.ingest_tables(spark, args.source, args.out)
        return
    docs, units = pipelines.ingest(spark, args.source)
    artifacts.export(docs, args.out, "document_name", artifacts.RAW)
    artifacts.export_chunks(chunk_paragraphs(docs), args.out)
    print(len(artifacts.export_units(units, args.out)), "documents")


def run_embed(spark, args, settings, provider) -> None:
    records = of_kind(pipelines.embed_folder(spark, args.source, args.cache, provider, args.document, args.source_kind, args.units, settings), args.source_kind)
    # embedded once: the artifacts and the summary read what this has written
    work = f"{args.cache.rstrip('/')}/_records-{uuid.uuid4().hex}"
    records.write.parquet(work)
    records = spark.read.parquet(work)
    suffix = f".{args.source_kind}" if args.source_kind else ""
    artifacts.export_records(records, args.cache, suffix)
    artifacts.export(run_summary(records), args.cache, "document_name", f"{suffix}{artifacts.SUMMARY}")
    artifacts.delete(spark, work)


def run_embed_tables(spark, args, settings, provider) -> None:
    pipelines.embed_tables(spark, args.root, provider, settings).show(truncate=False)


def run_follow(spark, args, settings, provider) -> None:
    print(pipelines.follow(spark, args.source, args.root, args.checkpoint, provider, _collection(spark, args, settings), settings), "batches")


def run_index(spark, args, settings, provider) -> None:
    store = _collection(spark, args, settings)
    (pipelines.index_tables if args.tables else pipelines.index_cache)(spark, args.cache, store).show(truncate=False)
    store.vacuum()
    if args.cells is not None:
        store.build_cells(args.cells or None)


def run_search(spark, args, settings, provider) -> None:
    questions, given = _question(spark, args)
    hits = pipelines.hits(_collection(spark, args, settings), questions, provider, args.limit, given["release_label"], given["source_kind"])
    hits.select("rank", "score", "payload.unit_id", preview(hits["payload.text"]).alias("text")).orderBy("rank").show(args.limit, truncate=False)


def run_answer(spark, args, settings, provider) -> None:
    questions, given = _question(spark, args)
    if args.min_top_score is not None:
        settings = replace(settings, retrieval_min_top_score=args.min_top_score)
    chat = ChatClient(clients.chat(settings), settings.chat_model, _ledger(spark, args, settings, settings.chat_model)) if args.provider == "remote" else None
    answers, hits = pipelines.ask(
        _collection(spark, args, settings), questions, provider, chat, args.limit, settings, release_label=given["release_label"], source_kind=given["source_kind"]
    )
    # one question, asked once: what is printed is what is traced
    answers, hits = (spark.createDataFrame(x.collect(), x.schema) for x in (answers, hits))
    print(json.dumps(json.loads(answers.select(artifacts.as_json(*answers.columns).alias("b")).first().b), indent=2, ensure_ascii=False))
    if args.trace_dir:
        print(*pipelines.traced(answers, hits, args.trace_dir, filters=given))


def run_evaluate(spark, args, settings, provider) -> None:
    totals, cases = pipelines.evaluate(_collection(spark, args, settings), artifacts.read_cases(spark, args.cases), provider, args.limit)
    cases.select("case_id", "passed", "outcome_as_expected", "failures").show(1000, truncate=False)
    print(artifacts.export_report(totals, cases, args.report))


def run_inspect(spark, args, settings, provider) -> None:
    c = _collection(spark, args, settings)
    c.info().show(truncate=False)
    c.sample().show(truncate=False)


def run_check_setup(spark, args, settings, provider) -> None:
    print(shown(settings))
    p = spark._jvm.org.apache.hadoop.fs.Path(args.out)
    print(args.out, p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


if __name__ == "__main__":
    raise SystemExit(main())
