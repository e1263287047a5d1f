"""Documents, tables, points, queries and answers made from the star-schema test tables.

Each adapter has a DataFrame form and the same rows as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.text import DEFAULT_NOISE
from stratalens.operators import chunking, embedding, search
from stratalens.operators.shared import folder as scratch  # noqa: F401
from stratalens.schemas import PAYLOAD, TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BOILERPLATE = ("Document Control", "1.1\tBackground\t9", "Version 1", "", " Copyright © 2024 ")


def _name() -> Column:
    return F.concat(F.lit("FS_"), "source", F.lit("_R"), F.col("doc_id") % 25, F.lit("_"), "lang", F.lit("_d"), "doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named documents with paragraphs (boilerplate first) and, for every seventh, three tables."""
    cell = lambda x: x if isinstance(x, Column) else F.lit(x)
    tab = lambda *rows: F.array(*[F.array(*map(cell, r)) for r in rows])
    tables = F.array(
        tab(("Column", "Description"), (" lang  code", F.col("lang")), ("source", F.col("source"))), tab(("",)), tab((F.col("source"),), (F.col("lang"), "x"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "text", _name().alias("document_name"), F.concat(F.lit("FS_"), "source").alias("document_family"),
        F.concat(F.lit("R"), F.col("doc_id") % 25).alias("release_label"), F.concat(F.array(*map(F.lit, BOILERPLATE)), F.split("text", "\n")).alias("paragraphs"),
        F.when(F.col("doc_id") % 7 == 0, tables).otherwise(F.array().cast(TABLES)).alias("tables"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.ingested(documents(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.contract(units(spark, sf_dir))


def is_even(name: Column) -> Column:
    """Documents whose units the test cache holds."""
    return F.regexp_extract(name, r"_d(\d+)$", 1).cast("long") % 2 == 0


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded records of even documents, one for each key; the vector is the text's length."""
    held = records(spark, sf_dir).where(is_even(F.col("document_name")))
    held = held.withColumn("vector", F.array(F.length("text").cast("double"))).withColumn("embedding_status", F.lit("embedded"))
    return embedding.last_wins(held, ["document_name", "unit_index"])


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each row of the embeddings table, with the document of the same number, where there is one, as payload."""
    v = F.col("vec_id")
    kind = F.when(F.col("label") % 2 == 0, "paragraph").otherwise("table")
    docs = documents(spark, sf_dir).select("doc_id", "document_name", "document_family", "release_label", "text")
    own = table(spark, sf_dir, "embeddings").join(docs, v == F.col("doc_id"), "left")
    given = {
        "unit_id": F.coalesce("document_name", F.concat(F.lit("vec_"), v)), "unit_index": F.lit(0), "source_kind": kind, "document_family": F.coalesce("document_family", F.lit("FS_none")),
        "release_label": F.coalesce("release_label", F.concat(F.lit("R"), v % 25)), "text": F.coalesce("text", F.lit("")),
    }
    payload = F.struct(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in PAYLOAD])
    vector = F.col("embedding").cast("array<double>")
    return own.select(F.concat(F.lit("p"), F.lpad(v.cast("string"), 9, "0")).alias("point_id"), vector.alias("vector"), embedding.unit(vector).alias("unit_vector"), payload.alias("payload"))


def number(query_id: Column) -> Column:
    """The running number of a query."""
    return F.floor(query_id / 100)


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whose id is divisible by 100 as queries; a third filter by kind, a third by release."""
    q, n = F.col("vec_id"), number(F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(
        q.alias("query_id"), F.concat(F.lit("What is said in note "), q, F.lit("?")).alias("query"), F.col("embedding").cast("array<double>").alias("query_vector"),
        F.when(n % 3 == 1, "paragraph").alias("source_kind"), F.when(n % 3 == 2, F.concat(F.lit("R"), n % 25)).alias("release_label"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_many(vector_points(spark, sf_dir), vector_queries(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation case for each query, of several kinds by its number."""
    q, n = F.col("query_id"), number(F.col("query_id"))
    expect = F.struct(
        F.when(n % 4 != 0, True).when(n % 8 == 0, False).alias("expected_to_pass"), (n % 7).cast("int").alias("min_results"),
        F.when(n % 3 == 2, F.concat(F.lit("R"), n % 25)).when(n % 5 == 0, "R1").alias("expected_release_label"), F.when(n % 2 == 0, "paragraph").alias("expected_source_kind"),
        F.when(n % 6 == 0, F.array(F.lit("zzz"), F.lit("it's"))).alias("expected_top1_contains_any"), F.when(n % 2 == 1, F.array(F.lit("the "), F.lit("der "))).alias("expected_text_contains_any"),
    )
    return vector_queries(spark, sf_dir).select(q.cast("string").alias("case_id"), "query", expect.alias("expectation"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as answers with citation marks, and up to four citations each."""
    mark = F.element_at(F.array(*[F.lit(x) for x in (" [C1]", " [C2] and [C1] and [C2]", "", " [C9][C1]", " [c1] [C01]")]), (F.col("turn") % 5 + 1).cast("int"))
    n = (F.col("conv_id") % 5).cast("int")
    cited = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", mark).alias("answer"), cited.alias("citations"), (F.col("turn") % 3 != 0).alias("is_answered"))


# --- the same in SQL -----------------------------------------------------------------------------


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


DOCS_SQL = """docs AS (
  SELECT doc_id, lang, source, text, 'FS_' || source || '_R' || (doc_id % 25) || '_' || lang || '_d' || doc_id AS document_name,
         'FS_' || source AS document_family, 'R' || (doc_id % 25) AS release_label,
         list_concat(['Document Control', '1.1' || chr(9) || 'Background' || chr(9) || '9', 'Version 1', '', ' Copyright © 2024 '], string_split(text, chr(10))) AS paragraphs
  FROM documents)"""
NOISE_SQL = (
    f"(s = '' OR s IN ({_quoted(DEFAULT_NOISE.exact)}) OR s IN ({_quoted(DEFAULT_NOISE.headings)}) OR regexp_matches(s, '^(\\d+(\\.\\d+)*)\\.?\\s+.+\\t\\d+$') OR "
    + " OR ".join(f"starts_with(s, {_quoted((p,))})" for p in DEFAULT_NOISE.prefixes) + " OR " + " OR ".join(f"contains(s, {_quoted((p,))})" for p in DEFAULT_NOISE.parts) + ")"
)
PARA_SQL = DOCS_SQL + r""", para AS (
  SELECT *, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM (SELECT *, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) - 1 AS pos FROM docs))"""
CHUNK_SQL = PARA_SQL + f""", clean AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM para WHERE NOT {NOISE_SQL}
), chunks AS (
  SELECT document_name, document_family, release_label, k // 5 AS chunk_index, document_name || '::chunk_' || (k // 5) AS chunk_id, min(k) AS paragraph_start_index,
         max(k) AS paragraph_end_index, count(*) AS paragraph_count, string_agg(s, chr(10) ORDER BY k) AS text
  FROM clean GROUP BY document_name, document_family, release_label, k // 5)"""
TABLE_SQL = """tabs AS (
  SELECT document_name, document_family, release_label, 0 AS table_index, 3 AS row_count, 2 AS column_count,
         'Column | Description' || chr(10) || 'lang code | ' || lang || chr(10) || 'source | ' || source AS text FROM docs WHERE doc_id % 7 = 0
  UNION ALL SELECT document_name, document_family, release_label, 1, 1, 1, '' FROM docs WHERE doc_id % 7 = 0
  UNION ALL SELECT document_name, document_family, release_label, 2, 2, 2, source || chr(10) || lang || ' | x' FROM docs WHERE doc_id % 7 = 0)"""
UNIT_SQL = CHUNK_SQL + ", " + TABLE_SQL + """, units AS (
  SELECT document_name, unit_id, row_number() OVER (PARTITION BY document_name ORDER BY o, i) - 1 AS unit_index, source_kind, text, document_family, release_label
  FROM (SELECT document_name, chunk_id AS unit_id, 0 AS o, chunk_index AS i, 'paragraph' AS source_kind, text, document_family, release_label FROM chunks
        UNION ALL SELECT document_name, document_name || '::table_chunk_' || table_index, 1, table_index, 'table', text, document_family, release_label FROM tabs WHERE text <> '')
), records AS (
  SELECT *, sha256('{"artifact_version":"v1","content_hash":"' || content_hash || '","embedding_model":"text-embedding-3-large"}') AS cache_key
  FROM (SELECT *, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM units))"""
CACHE_SQL = UNIT_SQL + """, cache AS (
  SELECT * FROM (SELECT *, length(text)::DOUBLE AS v, row_number() OVER (PARTITION BY cache_key ORDER BY document_name DESC, unit_index DESC) AS n
                 FROM records WHERE regexp_extract(document_name, '_d(\\d+)$', 1)::BIGINT % 2 = 0) WHERE n = 1)""".replace("\\\\", "\\")
POINT_ID_SQL = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1)
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || cache_key::BLOB) AS h))"""
HIT_SQL = DOCS_SQL + """, pts AS (
  SELECT 'p' || lpad(vec_id::VARCHAR, 9, '0') AS point_id, embedding::DOUBLE[] AS v, coalesce(document_name, 'vec_' || vec_id) AS unit_id, coalesce(document_family, 'FS_none') AS document_family,
         coalesce(release_label, 'R' || (vec_id % 25)) AS release_label, CASE WHEN label % 2 = 0 THEN 'paragraph' ELSE 'table' END AS source_kind, coalesce(text, '') AS text
  FROM embeddings LEFT JOIN docs ON vec_id = doc_id
), qs AS (
  SELECT vec_id AS query_id, 'What is said in note ' || vec_id || '?' AS query, embedding::DOUBLE[] AS q, CASE WHEN vec_id // 100 % 3 = 1 THEN 'paragraph' END AS f_kind,
         CASE WHEN vec_id // 100 % 3 = 2 THEN 'R' || (vec_id // 100 % 25) END AS f_release
  FROM embeddings WHERE vec_id % 100 = 0
), scored AS (
  SELECT query_id, point_id, round(list_cosine_similarity(v, q), 12) AS score, unit_id, document_family, release_label, source_kind, text
  FROM pts JOIN qs ON (f_kind IS NULL OR f_kind = source_kind) AND (f_release IS NULL OR f_release = release_label)
), hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM scored) WHERE rank <= 5
), gate AS (
  SELECT query_id, any_value(query) AS query, count(point_id) AS n, max(round(score, 6)) AS top FROM qs LEFT JOIN hits USING (query_id) GROUP BY query_id
), decided AS (
  SELECT *, n >= 2 AND top >= 0.9 AS ok,
         CASE WHEN n < 2 THEN 'Expected at least 2 results, got ' || n || '.' WHEN top < 0.9 THEN 'Top score ' || top || ' is below required threshold 0.9.'
              ELSE 'Retrieved evidence passed baseline sufficiency checks.' END AS reason FROM gate
), cited AS (
  SELECT query_id, count(*) AS n_cited, string_agg(unit_id || '|' || left(text, 240), ';' ORDER BY rank) AS cites,
         string_agg('[C' || rank || ']' || chr(10) || 'unit_id: ' || unit_id || chr(10) || 'document_family: ' || document_family || chr(10) || 'release_label: ' || release_label
           || chr(10) || 'source_kind: ' || source_kind || chr(10) || 'score: ' || printf('%.4f', round(score, 3)) || chr(10) || 'text: ' || left(text, 240), chr(10) || chr(10) ORDER BY rank) AS block,
         max(CASE WHEN rank = 1 THEN left(text, 240) END) AS first
  FROM hits GROUP BY query_id)"""
