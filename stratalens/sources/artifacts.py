"""JSON artifacts: one pretty-printed file for each document, and their strict readers.

The canonical store between stages is Parquet; these files are for import and export.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from stratalens.operators.embedding import usable
from stratalens.schemas import EVAL_CASE, RECORD_ARTIFACT
from stratalens.sources.files import Exported, full_uri, put, write_files

#: Suffixes of the artifacts' file names.
RAW, CHUNKS, UNITS, EMBEDDINGS, SUMMARY = ".json", ".chunks.json", ".retrieval_ready.json", ".embeddings.json", ".embedding_summary.json"


def as_json(*cols: str | Column) -> Column:
    """The columns as one object, nulls kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _indented(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False))


def export(rows: DataFrame, directory: str, stem: str, suffix: str) -> Exported:
    """Write each row as ``directory/<stem><suffix>``, indented, UTF-8; returns the paths, in order.

    The executors write the files under their names.  Stems name one row each.
    """
    kept = [c for c in rows.columns if c != "_stem"]
    body = F.pandas_udf(_indented, "string")(as_json(*kept))
    named = rows.select(F.concat(F.col(stem).cast("string"), F.lit(suffix)).alias("_name"), body.alias("_body"))
    return write_files(named, directory, "_name", "_body")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def export_units(units: DataFrame, directory: str) -> Exported:
    names = ["document_name", "document_family", "release_label"]
    unit = F.struct("unit_index", "unit_id", "source_kind", "text", "document_family", "release_label")
    by = units.groupBy(*names).agg(F.sort_array(F.collect_list(unit)).alias("units")).withColumn("total_units", F.size("units"))
    return export(by.select(*names, "total_units", "units"), directory, "document_name", UNITS)


def export_chunks(chunks: DataFrame, directory: str) -> Exported:
    names = ["document_name", "document_family", "release_label"]
    rest = [c for c in chunks.columns if c not in (*names, "chunk_index")]
    by = chunks.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("chunk_index", *rest))).alias("chunks")).withColumn("total_chunks", F.size("chunks"))
    return export(by.select(*names, "total_chunks", "chunks"), directory, "document_name", CHUNKS)


def export_records(records: DataFrame, directory: str, stem_suffix: str = "") -> Exported:
    """Embedding records of each document with their counts."""
    fields = [c for c in records.columns if c not in ("document_name", "unit_index")]
    status = lambda s: F.count_if(F.col("embedding_status") == s).cast("int")
    by = records.groupBy("document_name").agg(
        F.count("*").cast("int").alias("total_records"), status("cached").alias("cached_count"), status("embedded").alias("embedded_count"),
        F.count_if(F.col("embedding_status") != "cached").cast("int").alias("cache_miss_count"), F.sort_array(F.collect_list(F.struct("unit_index", *fields))).alias("records"),
    )
    return export(by, directory, "document_name", f"{stem_suffix}{EMBEDDINGS}")


def read_cache(spark: SparkSession, directory: str) -> DataFrame:
    """Usable records of all embedding artifacts with (file_path, position); none if the folder is absent."""
    p = spark._jvm.org.apache.hadoop.fs.Path(directory)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    reader = spark.read.schema(RECORD_ARTIFACT).option("multiLine", True).option("pathGlobFilter", f"*{EMBEDDINGS}")
    rows = reader.json(directory) if there else spark.createDataFrame([], RECORD_ARTIFACT)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))) if there else F.lit("")
    rows = rows.select(path.alias("file_path"), F.posexplode("records").alias("position", "r")).select("file_path", "position", "r.*")
    return usable(rows)


# The defaults of a case's parts; other keys are refused.
FILTERS = {"document_family": None, "release_label": None, "source_kind": None}
EXPECTATION = {
    "expected_to_pass": True, "min_results": 1, "expected_release_label": None, "expected_source_kind": None,
    "expected_top1_contains_any": None, "expected_text_contains_any": None,
}


def _part(name: str, known: dict, kind: DataType) -> tuple[Column, Column]:
    """A part of a case with its defaults for the keys that it lacks, and what is wrong with its keys, or null."""
    held, given = F.from_json(name, kind, {"mode": "FAILFAST"}), F.coalesce(F.json_object_keys(name), F.array().cast("array<string>"))
    values = [F.when(F.array_contains(given, k), held[k]).otherwise(F.lit(d).cast(kind[k].dataType)).alias(k) for k, d in known.items()]
    unknown = F.array_sort(F.array_distinct(F.array_except(given, F.array(*map(F.lit, known)))))
    return F.struct(*values).alias(name), F.when(F.size(unknown) > 0, F.concat(F.lit(f"Unexpected {name} keys: "), F.array_join(unknown, ", ")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array (a file), or of one object a line (a folder, as Spark writes it).

    Strictly checked where they lie, in one job: a missing or null ``case_id`` or ``query`` raises KeyError, an unknown key of
    ``filters`` or ``expectation`` TypeError, each with the first fault found.  Values of another type fail when they are read.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    raw = "case_id string, query string, notes string, filters string, expectation string"  # an object is read as its text
    rows = spark.read.schema(raw).option("multiLine", one).option("mode", "FAILFAST").json(path)
    kinds = StructType.fromDDL(EVAL_CASE)
    (filters, odd_filter), (expectation, odd_expectation) = _part("filters", FILTERS, kinds["filters"].dataType), _part("expectation", EXPECTATION, kinds["expectation"].dataType)
    missing = F.coalesce(*[F.when(F.col(c).isNull(), c) for c in ("case_id", "query")])
    told = rows.select(missing.alias("missing"), F.coalesce(odd_filter, odd_expectation).alias("unknown"))
    if fault := told.where("missing IS NOT NULL OR unknown IS NOT NULL").first():
        raise KeyError(f"{fault.missing} (in {path})") if fault.missing else TypeError(f"{fault.unknown} (in {path})")
    return rows.select("case_id", "query", filters, expectation, F.coalesce("notes", F.lit("")).alias("notes"))


def _report(uri: str):
    """The function of the task that writes the report: its first row has the totals, the others a case each."""

    def lines(rows: Iterator[str]) -> Iterator[str]:
        totals = json.loads(next(rows))
        yield "{\n" + "".join(f"  {json.dumps(k)}: {json.dumps(v)},\n" for k, v in totals.items()) + '  "cases": ['
        between = "\n"
        for row in rows:  # a line break within a text is escaped
            yield between + "\n".join(f"    {x}" for x in json.dumps(json.loads(row), indent=2, ensure_ascii=False).split("\n"))
            between = ",\n"
        yield "]\n}" if between == "\n" else "\n  ]\n}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put(uri, lines(body for b in batches for body in b["body"]))
        yield pd.DataFrame({"written": [1]})

    return write


def export_report(totals: DataFrame, cases: DataFrame, path: str) -> str:
    """The evaluation report as one file, in order of case; folders are made.

    One task writes it row by row, from a sort that may spill: a report of any number of cases passes neither the driver nor a task's memory as a whole.
    """
    case = F.struct("case_id", "query", "filters", "expectation", "notes").alias("case")
    result = F.struct("case_id", "passed", "expected_to_pass", "outcome_as_expected", "result_count", "failures").alias("evaluation")
    head = totals.select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("case_id"), as_json(*totals.columns).alias("body"))
    rows = cases.select(F.lit(1).alias("part"), "case_id", as_json(case, result, F.col("hits").alias("top_results")).alias("body"))
    every = head.unionByName(rows).repartition(1).sortWithinPartitions("part", "case_id", "body").select("body")
    every.mapInPandas(_report(full_uri(totals.sparkSession, path)), "written int").write.format("noop").mode("overwrite").save()
    return path
