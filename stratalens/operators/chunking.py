"""From paragraphs and tables to retrieval units.

A document is one row: document_name, document_family, release_label, paragraphs, tables.  All steps
keep arrays on the document's row and explode at the end, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import DEFAULT_NOISE, NoiseRules, collapse, is_bare_noise, strip

NAMES = ("document_name", "document_family", "release_label")


def extracted(docs: DataFrame) -> DataFrame:
    """Stripped paragraphs, their counts and the full text without blank ones."""
    bare = F.transform("paragraphs", strip)
    full = F.filter(bare, lambda p: p != "")
    return docs.withColumn("paragraphs", bare).withColumns({
        "paragraph_count": F.size("paragraphs"), "non_empty_paragraph_count": F.size(full), "full_text": F.array_join(full, "\n"),
    })


def table_text(rows: Column) -> Column:
    """Cells joined by `` | ``, rows by line ends."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def described_tables(docs: DataFrame) -> DataFrame:
    """``tables`` with collapsed cells as structs: index, rows, counts and text; rows may be ragged."""
    clean = F.transform("tables", lambda t: F.transform(t, lambda r: F.transform(r, collapse)))

    def described(rows: Column, i: Column) -> Column:
        return F.struct(
            i.alias("table_index"), F.size(rows).alias("row_count"), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)).alias("column_count"),
            rows.alias("rows"), table_text(rows).alias("text_representation"),
        )

    return docs.withColumn("tables", F.transform(clean, described)).withColumn("table_count", F.size("tables"))


def normalized(docs: DataFrame, rules: NoiseRules = DEFAULT_NOISE) -> DataFrame:
    """Adds the paragraphs that are no boilerplate, their text, and counts (blank ones never count as removed)."""
    # stripped once: every test below looks at bare paragraphs only
    out = docs.withColumn("_bare", F.filter(F.transform("paragraphs", strip), lambda p: p != ""))
    out = out.withColumn("cleaned_paragraphs", F.filter("_bare", lambda p: ~is_bare_noise(p, rules))).withColumn("original_non_empty_paragraph_count", F.size("_bare")).drop("_bare")
    return out.withColumns({
        "cleaned_paragraph_count": F.size("cleaned_paragraphs"), "cleaned_full_text": F.array_join("cleaned_paragraphs", "\n"),
        "removed_paragraph_count": F.col("original_non_empty_paragraph_count") - F.size("cleaned_paragraphs"),
    })


def chunk_array(paragraphs: Column, name: Column, size: int) -> Column:
    """Chunks of ``size`` paragraphs, the last may be shorter; none of no paragraphs."""
    if size <= 0:
        raise ValueError("max_paragraphs_per_chunk must be greater than 0")
    n = F.size(paragraphs)

    def chunk(i: Column) -> Column:
        own = F.slice(paragraphs, i * size + 1, F.lit(size))
        return F.struct(
            F.concat(name, F.lit("::chunk_"), i).alias("chunk_id"), i.alias("chunk_index"), (i * size).alias("paragraph_start_index"),
            (F.least((i + 1) * size, n) - 1).alias("paragraph_end_index"), F.size(own).alias("paragraph_count"), F.array_join(own, "\n").alias("text"),
        )

    count = F.ceil(n / size).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count), chunk)


def table_chunk_array(tables: Column, name: Column) -> Column:
    """A chunk for each table whose text is not blank; numbers count all tables, so they have gaps."""
    def chunk(t: Column, i: Column) -> Column:
        return F.struct(
            F.concat(name, F.lit("::table_chunk_"), i).alias("chunk_id"), i.alias("chunk_index"), t["table_index"].alias("table_index"),
            t["row_count"].alias("row_count"), t["column_count"].alias("column_count"), t["text_representation"].alias("text"),
        )

    return F.filter(F.transform(tables, chunk), lambda c: strip(c["text"]) != "")


def chunk_paragraphs(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row for each chunk of normalized documents."""
    return docs.select(*NAMES, F.inline(chunk_array(F.col("cleaned_paragraphs"), F.col("document_name"), size)))


def chunk_tables(docs: DataFrame) -> DataFrame:
    """One row for each chunk of documents with described tables."""
    return docs.select(*NAMES, F.inline(table_chunk_array(F.col("tables"), F.col("document_name"))))


def retrieval_units(docs: DataFrame, size: int = 5) -> DataFrame:
    """Paragraph chunks, then table chunks, numbered densely in each document."""
    slim = lambda chunks, kind: F.transform(chunks, lambda c: F.struct(c["chunk_id"].alias("unit_id"), F.lit(kind).alias("source_kind"), c["text"].alias("text")))
    name = F.col("document_name")
    both = F.concat(slim(chunk_array(F.col("cleaned_paragraphs"), name, size), "paragraph"), slim(table_chunk_array(F.col("tables"), name), "table"))
    exploded = docs.select(*NAMES, F.posexplode(both).alias("unit_index", "u"))
    return exploded.select("document_name", "u.unit_id", "unit_index", "u.source_kind", "u.text", "document_family", "release_label")


def ingested(docs: DataFrame, rules: NoiseRules = DEFAULT_NOISE, size: int = 5) -> DataFrame:
    """Units of raw documents."""
    return retrieval_units(described_tables(normalized(docs, rules)), size)
