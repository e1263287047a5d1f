"""The registered queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import hashing, text
from stratalens.operators import answer, cells, chunking, embedding, evaluation, evidence, index, search, shared, trace
from stratalens.plans import testdata as T
from stratalens.sources import artifacts, tables
from stratalens.sources.docx import base_name, is_document
from stratalens.sources.ledger import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- names, paragraphs, tables -------------------------------------------------------------------


@query(f"""WITH {T.DOCS_SQL} SELECT doc_id, document_name, document_family, release_label, (doc_id % 25) AS release_number,
  lang || '_d' || doc_id AS variant_suffix, 'docx' AS source_type FROM docs""")
def filename_parse(spark, sf):
    named = T.documents(spark, sf).select("doc_id", text.parsed_name(F.concat("document_name", F.lit(".docx"))).alias("n"))
    return named.select("doc_id", "n.*")


@query(f"""WITH {T.DOCS_SQL}, names AS (SELECT unnest([document_name || '.docx', '~$' || document_name || '.docx', document_name || '.DOCX', document_name || '.txt', '.docx']) AS file_name FROM docs)
  SELECT file_name FROM names WHERE lower(file_name) LIKE '_%.docx' AND NOT starts_with(file_name, '~$')""")
def docx_name_filter(spark, sf):
    n = F.col("document_name")
    names = F.array(F.concat(n, F.lit(".docx")), F.concat(F.lit("~$"), n, F.lit(".docx")), F.concat(n, F.lit(".DOCX")), F.concat(n, F.lit(".txt")), F.lit(".docx"))
    paths = T.documents(spark, sf).select(F.explode(F.transform(names, lambda x: F.concat(F.lit("/specs dir/"), x))).alias("path"))
    return paths.select(base_name(F.col("path")).alias("file_name")).where(is_document(F.col("file_name")))


@query(f"""WITH {T.PARA_SQL} SELECT doc_id, count(*) AS paragraph_count, count(*) FILTER (s <> '') AS non_empty_paragraph_count,
  string_agg(s, chr(10) ORDER BY pos) FILTER (s <> '') AS full_text FROM para GROUP BY doc_id""")
def paragraph_extract(spark, sf):
    return chunking.extracted(T.documents(spark, sf)).select("doc_id", F.col("paragraph_count").cast("long").alias("paragraph_count"), F.col("non_empty_paragraph_count").cast("long").alias("non_empty_paragraph_count"), "full_text")


@query(f"WITH {T.DOCS_SQL}, {T.TABLE_SQL} SELECT document_name, table_index, row_count, column_count, text AS text_representation FROM tabs")
def table_text(spark, sf):
    docs = chunking.described_tables(T.documents(spark, sf))
    return docs.select("document_name", F.inline("tables")).select("document_name", "table_index", "row_count", "column_count", "text_representation")


@query(f"""WITH {T.PARA_SQL} SELECT doc_id, pos, {T.NOISE_SQL} AS noise, s IN ('Document Control', 'Change Record', 'Reviewers', 'Approvers', 'Traceability Matrix', 'Table of Contents') AS heading,
  regexp_matches(s, '^(\\d+(\\.\\d+)*)\\.?\\s+.+\\t\\d+$') AS toc FROM para""".replace("\\\\", "\\"))
def noise_filter(spark, sf):
    rows = T.documents(spark, sf).select("doc_id", F.posexplode("paragraphs").alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), text.is_noise(F.col("p")).alias("noise"), text.is_heading(text.strip(F.col("p"))).alias("heading"), text.is_toc_line(F.col("p")).alias("toc"))


@query(f"""WITH {T.PARA_SQL} SELECT doc_id, count(*) FILTER (s <> '') AS original_non_empty_paragraph_count, count(*) FILTER (NOT {T.NOISE_SQL}) AS cleaned_paragraph_count,
  count(*) FILTER (s <> '') - count(*) FILTER (NOT {T.NOISE_SQL}) AS removed_paragraph_count, coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER (NOT {T.NOISE_SQL}), '') AS cleaned_full_text FROM para GROUP BY doc_id""")
def normalize(spark, sf):
    counts = ("original_non_empty_paragraph_count", "cleaned_paragraph_count", "removed_paragraph_count")
    return chunking.normalized(T.documents(spark, sf)).select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts], "cleaned_full_text")


@query(f"WITH {T.CHUNK_SQL} SELECT document_name, chunk_id, chunk_index, paragraph_start_index, paragraph_end_index, paragraph_count, text FROM chunks")
def chunk_paragraphs(spark, sf):
    out = chunking.chunk_paragraphs(chunking.normalized(T.documents(spark, sf)))
    ints = ("chunk_index", "paragraph_start_index", "paragraph_end_index", "paragraph_count")
    return out.select("document_name", "chunk_id", *[F.col(c).cast("long").alias(c) for c in ints], "text")


@query(f"WITH {T.DOCS_SQL}, {T.TABLE_SQL} SELECT document_name, document_name || '::table_chunk_' || table_index AS chunk_id, table_index AS chunk_index, table_index, row_count, column_count, text FROM tabs WHERE text <> ''")
def chunk_tables(spark, sf):
    return chunking.chunk_tables(chunking.described_tables(T.documents(spark, sf))).drop("document_family", "release_label")


@query(f"WITH {T.UNIT_SQL} SELECT document_name, unit_id, unit_index, source_kind, text, document_family, release_label FROM units")
def retrieval_units(spark, sf):
    return T.units(spark, sf).withColumn("unit_index", F.col("unit_index").cast("long"))


@query(f"""WITH {T.UNIT_SQL} SELECT document_name, count(*) AS units, count(*) FILTER (source_kind = 'table') AS tables, max(length(text)) AS longest FROM units GROUP BY document_name""")
def document_counts(spark, sf):
    return T.units(spark, sf).groupBy("document_name").agg(F.count("*").alias("units"), F.count_if(F.col("source_kind") == "table").alias("tables"), F.max(F.length("text")).cast("long").alias("longest"))


# --- keys and embedding --------------------------------------------------------------------------


@query("SELECT doc_id, sha256(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM (SELECT doc_id, text || chr(13) || chr(10) || 'x' || chr(13) AS t FROM documents)")
def content_hash(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.concat("text", F.lit("\r\nx\r"))).alias("content_hash"))


@query(f"WITH {T.UNIT_SQL} SELECT unit_id, cache_key, {T.POINT_ID_SQL} AS point_id FROM records")
def record_keys(spark, sf):
    return T.records(spark, sf).select("unit_id", "cache_key", hashing.point_id(F.col("cache_key")).alias("point_id"))


@query(f"""WITH {T.UNIT_SQL} SELECT unit_id, source_kind, content_hash, cache_key, 'v1' AS artifact_version, 'text-embedding-3-large' AS embedding_model, 'pending' AS embedding_status FROM records""")
def embedding_contract(spark, sf):
    return T.records(spark, sf).select("unit_id", "source_kind", "content_hash", "cache_key", "artifact_version", "embedding_model", "embedding_status")


@query(f"WITH {T.CACHE_SQL} SELECT cache_key, unit_id, release_label, v AS length FROM cache")
def cache_last_wins(spark, sf):
    return T.cache(spark, sf).select("cache_key", "unit_id", "release_label", F.col("vector")[0].alias("length"))


@query("""SELECT 'k' || (label::VARCHAR) AS cache_key, count(DISTINCT v) AS vectors, count(DISTINCT v) > 1 AS has_conflict
  FROM (SELECT label, CASE WHEN label % 2 = 0 THEN 1.0 ELSE vec_id % 3 END AS v FROM embeddings WHERE label IS NOT NULL) GROUP BY label""")
def cache_conflicts(spark, sf):
    made = F.when(F.col("label") % 2 == 0, F.lit(1.0)).otherwise((F.col("vec_id") % 3).cast("double"))
    rows = T.table(spark, sf, "embeddings").where("label IS NOT NULL").select(F.concat(F.lit("k"), "label").alias("cache_key"), F.array(made).alias("vector"))
    return embedding.conflicts(rows)


@query(f"""WITH {T.CACHE_SQL} SELECT r.unit_id, CASE WHEN c.v IS NULL THEN 'embedded' ELSE 'cached' END AS embedding_status, c.v AS cached_length FROM records r LEFT JOIN cache c USING (cache_key)""")
def cache_join(spark, sf):
    out = embedding.embed(T.records(spark, sf), embedding.HashProvider(), T.cache(spark, sf))
    hit = F.col("embedding_status") == "cached"
    return out.select("unit_id", "embedding_status", F.when(hit, F.col("vector")[0]).alias("cached_length"))


@query(f"WITH {T.CACHE_SQL} SELECT unit_id, cache_key FROM cache WHERE cache_key = (SELECT min(cache_key) FROM cache)")
def cache_lookup(spark, sf):
    held = T.cache(spark, sf)
    return embedding.lookup(held, held.agg(F.min("cache_key")).first()[0]).select("unit_id", "cache_key")


_STATUS = "s AS (SELECT r.*, CASE WHEN c.v IS NULL THEN 'pending' ELSE 'cached' END AS status FROM records r LEFT JOIN cache c USING (cache_key))"
_COUNTS = """count(*) AS total_records, count(*) FILTER (status = 'cached') AS cached_count, 0::BIGINT AS embedded_count, count(*) FILTER (status <> 'cached') AS cache_miss_count,
  coalesce(count(*) FILTER (status = 'cached') / nullif(count(*), 0)::DOUBLE, 0) AS cache_hit_rate"""


@query(f"WITH {T.CACHE_SQL}, {_STATUS} SELECT {_COUNTS} FROM s")
def cache_metrics(spark, sf):
    return embedding.metrics(embedding.with_cache(T.records(spark, sf), T.cache(spark, sf)))


@query(f"WITH {T.CACHE_SQL}, {_STATUS} SELECT document_name, {_COUNTS}, 'text-embedding-3-large' AS models, 'v1' AS versions FROM s GROUP BY document_name")
def run_summary(spark, sf):
    out = embedding.run_summary(embedding.with_cache(T.records(spark, sf), T.cache(spark, sf)))
    return out.withColumn("models", F.array_join("embedding_models", ",")).withColumn("versions", F.array_join("artifact_versions", ",")).drop("embedding_models", "artifact_versions")


@query(f"WITH {T.UNIT_SQL} SELECT unit_id, unit_index FROM units ORDER BY unit_index, unit_id LIMIT 40")
def first_units(spark, sf):
    return embedding.first_units(T.records(spark, sf), 40).select("unit_id", F.col("unit_index").cast("long").alias("unit_index"))


@query(f"WITH {T.UNIT_SQL} SELECT unit_id FROM units WHERE source_kind = 'table'")
def units_of_kind(spark, sf):
    return embedding.of_kind(T.records(spark, sf), "table").select("unit_id")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
  SELECT doc_id, ('0x' || left(sha256(word), 2))::INT % 64 AS slot, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL""")
def hash_embed_slots(spark, sf):
    slots = embedding.HashProvider().slots(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", F.explode(slots).alias("slot")).groupBy("doc_id", "slot").agg(F.count("*").alias("n"))


# --- the collection and search -------------------------------------------------------------------


@query(f"""WITH {T.CACHE_SQL} SELECT {T.POINT_ID_SQL} AS point_id, v AS vector, CASE WHEN v > 0 THEN 1.0::DOUBLE END AS unit, unit_id, source_kind FROM cache""")
def points(spark, sf):
    out = index.points(T.cache(spark, sf))
    return out.select("point_id", F.col("vector")[0].alias("vector"), F.col("unit_vector")[0].alias("unit"), "payload.unit_id", "payload.source_kind")


@query(f"""WITH {T.DOCS_SQL}, p AS (SELECT 'p' || lpad(vec_id::VARCHAR, 9, '0') AS point_id, vec_id FROM embeddings)
  SELECT point_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM p""")
def upsert_merge(spark, sf):
    every = T.vector_points(spark, sf)
    n = F.substring("point_id", 2, 9).cast("long")
    version = lambda v: F.col("payload").withField("text", F.lit(v))
    old, new = every.withColumn("payload", version("old")), every.where(n % 3 == 0).withColumn("payload", version("new"))
    return index.upserted(old, new).select("point_id", F.col("payload.text").alias("version"))


@query(f"WITH {T.CACHE_SQL}, {_STATUS} SELECT 'functional_specs' AS collection_name, count(*) AS attempted_records, count(*) FILTER (status = 'cached') AS upserted_points, count(*) FILTER (status <> 'cached') AS skipped_records FROM s")
def upsert_summary(spark, sf):
    return index.upsert_summary(embedding.with_cache(T.records(spark, sf), T.cache(spark, sf)), "functional_specs")


@query(f"WITH {T.HIT_SQL} SELECT count(*) AS points_count, count(DISTINCT release_label) AS releases FROM pts")
def index_info(spark, sf):
    return T.vector_points(spark, sf).agg(F.count("*").alias("points_count"), F.countDistinct("payload.release_label").alias("releases"))


def _store(spark, sf) -> index.Collection:
    """A collection into which the test cache has been upserted twice, so that the second replaces the first."""
    store = index.Collection(spark, T.scratch(spark), size=1, buckets=4)
    store.ensure()
    cached = T.cache(spark, sf)
    store.upsert(cached.where("source_kind = 'table'").withColumn("vector", F.array(F.lit(7.0))))
    store.upsert(cached)
    return store


@query(f"""WITH {T.CACHE_SQL} SELECT {T.POINT_ID_SQL} AS point_id, v AS vector, unit_id, source_kind, release_label FROM cache""")
def collection_points(spark, sf):
    return _store(spark, sf).read().select("point_id", F.col("vector")[0].alias("vector"), "payload.unit_id", "payload.source_kind", "payload.release_label")


@query(f"WITH {T.CACHE_SQL} SELECT 'functional_specs' AS collection_name, 1 AS vector_size, 'cosine' AS distance, count(*) AS points_count FROM cache")
def collection_info(spark, sf):
    return _store(spark, sf).info()


@query(f"WITH {T.CACHE_SQL} SELECT {T.POINT_ID_SQL} AS point_id, unit_id FROM cache WHERE source_kind = 'table' AND release_label = 'R4'")
def collection_pruned(spark, sf):
    return _store(spark, sf).read("R4", "table").select("point_id", "payload.unit_id")


@query(f"WITH {T.CACHE_SQL} SELECT cache_key, unit_id, text, v AS vector FROM cache")
def cache_files(spark, sf):
    """The test cache written as embedding artifacts and read back."""
    folder = T.scratch(spark)
    artifacts.export_records(T.cache(spark, sf), folder)
    return artifacts.read_cache(spark, folder).select("cache_key", "unit_id", "text", F.col("vector")[0].alias("vector"))


@query(f"""WITH {T.UNIT_SQL} SELECT document_name, unit_id, unit_index, source_kind, CASE WHEN regexp_extract(document_name, '_d([0-9]+)$', 1)::BIGINT % 2 = 0 THEN text ELSE 'old ' || text END AS text,
  document_family, release_label FROM units""")
def table_rerun(spark, sf):
    """The table of units written whole with other texts, then by a rerun over the even documents, and read back."""
    units, table = T.units(spark, sf), tables.Table(spark, T.scratch(spark), tables.UNITS)
    table.write(units.withColumn("text", F.concat(F.lit("old "), "text")))
    table.write(units.where(T.is_even(F.col("document_name"))))
    return table.read().select("document_name", "unit_id", F.col("unit_index").cast("long").alias("unit_index"), "source_kind", "text", "document_family", "release_label")


def _vector(spark, sf) -> list[float]:
    return list(T.table(spark, sf, "embeddings").where("vec_id = 3").select(F.col("embedding").cast("array<double>")).first()[0])


_ONE = "SELECT point_id, round(list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 12) AS s FROM pts"


@query(f"WITH {T.HIT_SQL} SELECT row_number() OVER (ORDER BY s DESC, point_id) AS rank, point_id, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, point_id LIMIT 5")
def vector_topk(spark, sf):
    out = search.search(T.vector_points(spark, sf), _vector(spark, sf))
    return out.select(F.col("rank").cast("long").alias("rank"), "point_id", F.round("score", 6).alias("score"))


@query(f"WITH {T.HIT_SQL} SELECT row_number() OVER (ORDER BY s DESC, point_id) AS rank, point_id, round(s, 6) AS score FROM ({_ONE} WHERE source_kind = 'table' AND document_family = 'FS_src1') ORDER BY s DESC, point_id LIMIT 3")
def vector_topk_filtered(spark, sf):
    out = search.search(T.vector_points(spark, sf), _vector(spark, sf), 3, source_kind="table", document_family="FS_src1")
    return out.select(F.col("rank").cast("long").alias("rank"), "point_id", F.round("score", 6).alias("score"))


@query(f"WITH {T.HIT_SQL} SELECT query_id, rank, point_id, round(score, 6) AS score, source_kind, release_label FROM hits")
def vector_topk_batch(spark, sf):
    out = T.hits(spark, sf)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "point_id", F.round("score", 6).alias("score"), "payload.source_kind", "payload.release_label")


@query(SQL["vector_topk_batch"])
def vector_topk_pruned(spark, sf):
    """The same from a layout by centroids, of which only cells that may hold a result are read."""
    laid = cells.CellIndex.build(T.vector_points(spark, sf), T.scratch(spark))
    out = laid.search_many(T.vector_queries(spark, sf))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "point_id", F.round("score", 6).alias("score"), "payload.source_kind", "payload.release_label")


_BAG = "unnest(regexp_split_to_array(lower({0}), '[^a-z]+')) AS word"
_SLOTS = "('0x' || left(sha256(word), 2))::INT % 64 AS slot, count(*)::DOUBLE AS c"


@query(f"""WITH {T.UNIT_SQL}, once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY document_name DESC, unit_index DESC) AS n FROM records) WHERE n = 1
), u AS (SELECT cache_key, {_SLOTS} FROM (SELECT cache_key, {_BAG.format('text')} FROM once) WHERE word <> '' GROUP BY ALL),
q AS (SELECT item_id, {_SLOTS} FROM (SELECT item_id, {_BAG.format('text')} FROM benchmark) WHERE word <> '' GROUP BY ALL),
ul AS (SELECT cache_key, sqrt(sum(c * c)) AS l FROM u GROUP BY cache_key), ql AS (SELECT item_id, sqrt(sum(c * c)) AS l FROM q GROUP BY item_id),
d AS (SELECT item_id, cache_key, sum(u.c * q.c) AS d FROM u JOIN q USING (slot) GROUP BY ALL),
s AS (SELECT item_id, round(d / (ul.l * ql.l), 12) AS s, {T.POINT_ID_SQL} AS point_id FROM d JOIN ul USING (cache_key) JOIN ql USING (item_id))
SELECT query_id, rank, round(s, 6) AS score FROM (SELECT item_id AS query_id, s, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, point_id) AS rank FROM s) WHERE rank <= 5""")
def text_search(spark, sf):
    provider = embedding.HashProvider()
    # dealt evenly, not by bytes: the embedding takes far longer than the move
    dealt = T.records(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cache_key")
    once = embedding.last_wins(dealt, ["document_name", "unit_index"])
    # embedded once: filters and the search's count, grid and join look at what is written
    store = index.points(shared.kept(provider.embed(once, "text", "vector")), strict=False)
    asked = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = search.search_texts(store, asked, provider)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT doc_id, replace(left(text, 300), chr(10), ' ') AS preview FROM documents")
def text_preview(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", search.preview(F.col("text")).alias("preview"))


# --- evidence, answers, evaluation ---------------------------------------------------------------

_RULES = {"min_results": 2, "min_top_score": 0.9}


def _rounded(spark, sf, digits: int = 6) -> DataFrame:
    return T.hits(spark, sf).withColumn("score", F.round("score", digits))


@query(f"WITH {T.HIT_SQL} SELECT query_id, ok AS is_sufficient, reason, n AS result_count, top AS top_score FROM decided")
def evidence_sufficiency(spark, sf):
    out = evidence.assess(T.vector_queries(spark, sf), _rounded(spark, sf), **_RULES)
    return out.withColumn("result_count", F.col("result_count").cast("long"))


@query(f"""WITH {T.HIT_SQL}, joined AS (SELECT query_id, count(point_id) AS n, coalesce(string_agg(text, chr(10) ORDER BY rank), '') AS t FROM qs LEFT JOIN hits USING (query_id) GROUP BY query_id)
  SELECT query_id, n >= 1 AND (contains(t, 'stupid') OR contains(t, 'token =')) AS is_sufficient FROM joined""")
def evidence_markers(spark, sf):
    out = evidence.assess(T.vector_queries(spark, sf), T.hits(spark, sf), min_top_score=0.0, markers=["stupid", "token ="])
    return out.select("query_id", "is_sufficient")


@query(f"WITH {T.HIT_SQL} SELECT query_id, cites FROM cited")
def citations(spark, sf):
    rows = evidence.gathered(T.vector_queries(spark, sf), T.hits(spark, sf)).where(F.size("hits") > 0)
    told = F.transform(answer.citations(F.col("hits")), lambda c: F.concat(c["unit_id"], F.lit("|"), c["text_preview"]))
    return rows.select("query_id", F.array_join(told, ";").alias("cites"))


@query(f"WITH {T.HIT_SQL} SELECT query_id, coalesce(block, 'No evidence was provided.') AS evidence FROM qs LEFT JOIN cited USING (query_id)")
def evidence_block(spark, sf):
    rows = evidence.gathered(T.vector_queries(spark, sf), _rounded(spark, sf, 3))
    return rows.select("query_id", answer.evidence_block(answer.citations(F.col("hits"))).alias("evidence"))


@query(f"""WITH {T.HIT_SQL} SELECT query_id, 'User question:' || chr(10) || query || chr(10) || chr(10) || 'Evidence sufficiency:' || chr(10) || '- is_sufficient: ' || CASE WHEN n3 >= 1 AND top3 >= 0.3 THEN 'True' ELSE 'False' END
  || chr(10) || '- reason: ' || CASE WHEN n3 < 1 THEN 'Expected at least 1 results, got 0.' WHEN top3 < 0.3 THEN 'Top score ' || top3 || ' is below required threshold 0.3.' ELSE 'Retrieved evidence passed baseline sufficiency checks.' END
  || chr(10) || '- top_score: ' || coalesce(top3::VARCHAR, 'None') || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(block, 'No evidence was provided.') || chr(10) || chr(10) || 'Task:' || chr(10)
  || 'Answer the user question using only the evidence above.' || chr(10) || 'If the evidence is insufficient, say that the indexed evidence is insufficient and do not invent details.' || chr(10)
  || 'Include citations like [C1], [C2] next to supported claims.' || chr(10) AS user_prompt
  FROM (SELECT query_id, any_value(query) AS query, count(point_id) AS n3, max(round(score, 3)) AS top3 FROM qs LEFT JOIN hits USING (query_id) GROUP BY query_id) LEFT JOIN cited USING (query_id)""")
def grounded_prompt(spark, sf):
    rows = evidence.gathered(T.vector_queries(spark, sf), _rounded(spark, sf, 3))
    return rows.select("query_id", answer.user_prompt(F.col("query"), evidence.sufficiency(F.col("hits")), answer.citations(F.col("hits"))).alias("user_prompt"))


_REPLY = """r AS (SELECT conv_id, turn, text || [' [C1]', ' [C2] and [C1] and [C2]', '', ' [C9][C1]', ' [c1] [C01]'][(turn % 5 + 1)::INT] AS answer, (conv_id % 5)::INT AS n, turn % 3 <> 0 AS answered FROM conversations),
v AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[C(\\d+)\\]', 1), lambda x: 'C' || x) AS ids, list_transform(range(1, n + 1), lambda i: 'C' || i) AS have FROM r),
w AS (SELECT *, list_filter(ids, lambda x: NOT list_contains(have, x)) AS bad, answered AND n > 0 AND len(ids) = 0 AS missing FROM v)""".replace("\\\\", "\\")


@query(f"WITH {_REPLY} SELECT conv_id, turn, array_to_string(ids, ',') AS cited_ids, array_to_string(have, ',') AS available_ids FROM w")
def citation_extract(spark, sf):
    ids = lambda c: F.array_join(c, ",")
    return T.replies(spark, sf).select("conv_id", "turn", ids(answer.cited_ids(F.col("answer"))).alias("cited_ids"), ids(answer.available_ids(F.col("citations"))).alias("available_ids"))


@query(f"WITH {_REPLY} SELECT conv_id, turn, len(bad) = 0 AND NOT missing AS is_valid, array_to_string(bad, ',') AS invalid_ids, missing AS missing_citation FROM w")
def citation_validate(spark, sf):
    out = T.replies(spark, sf).select("conv_id", "turn", answer.validation(F.col("answer"), F.col("citations"), F.col("is_answered")).alias("v"))
    return out.select("conv_id", "turn", "v.is_valid", F.array_join("v.invalid_ids", ",").alias("invalid_ids"), "v.missing_citation")


@query("""SELECT conv_id, turn, p / 1000.0::DOUBLE * 0.1::DOUBLE AS input_cost, c / 1000.0::DOUBLE * 0.3::DOUBLE AS output_cost, p / 1000.0::DOUBLE * 0.1::DOUBLE + c / 1000.0::DOUBLE * 0.3::DOUBLE AS total_cost, 'USD' AS currency
  FROM (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN len(text)::DOUBLE END AS p, CASE WHEN turn % 4 <> 3 THEN (conv_id % 50)::DOUBLE END AS c FROM conversations)""")
def llm_cost(spark, sf):
    known = F.when(F.col("turn") % 4 != 3, F.length("text")).cast("int")
    usage = F.struct(F.lit("m").alias("model"), known.alias("prompt_tokens"), (F.col("conv_id") % 50).cast("int").alias("completion_tokens"), F.lit(None).cast("int").alias("total_tokens"))
    out = T.table(spark, sf, "conversations").select("conv_id", "turn", answer.cost(usage, 0.1, 0.3).alias("c"))
    return out.select("conv_id", "turn", "c.input_cost", "c.output_cost", "c.total_cost", "c.currency")


@query(f"""WITH {T.HIT_SQL} SELECT query_id, ok AS is_answered, CASE WHEN ok THEN first || ' [C1]' ELSE '{answer.REFUSAL}' END AS answer, CASE WHEN NOT ok THEN reason END AS refusal_reason,
  coalesce(n_cited, 0) AS citations FROM decided LEFT JOIN cited USING (query_id)""")
def grounded_answers(spark, sf):
    out = answer.grounded_answers(T.vector_queries(spark, sf), _rounded(spark, sf), **_RULES)
    return out.select("query_id", "is_answered", "answer", "refusal_reason", F.size("citations").cast("long").alias("citations"))


_CASE = T.HIT_SQL + """, e AS (
  SELECT query_id, count(point_id) AS n, query_id // 100 % 7 AS least, CASE WHEN query_id // 100 % 4 <> 0 THEN true WHEN query_id // 100 % 8 = 0 THEN false ELSE true END AS expect,
    CASE WHEN query_id // 100 % 3 = 2 THEN 'R' || (query_id // 100 % 25) WHEN query_id // 100 % 5 = 0 THEN 'R1' END AS want_release, CASE WHEN query_id // 100 % 2 = 0 THEN 'paragraph' END AS want_kind,
    string_agg(text, chr(10) ORDER BY rank) AS t, max(CASE WHEN rank = 1 THEN text END) AS t1, list(release_label ORDER BY rank) AS rel, list(source_kind ORDER BY rank) AS kinds
  FROM qs LEFT JOIN hits USING (query_id) GROUP BY query_id
), f AS (SELECT *, list_filter(CASE WHEN n = 0 THEN [] ELSE rel END, lambda x: x IS DISTINCT FROM want_release) AS other_rel, list_filter(CASE WHEN n = 0 THEN [] ELSE kinds END, lambda x: x IS DISTINCT FROM want_kind) AS other_kind FROM e),
g AS (SELECT *, list_filter([
    CASE WHEN n < least THEN 'Expected at least ' || least || ' results, got ' || n END,
    CASE WHEN want_release IS NOT NULL AND len(other_rel) > 0 THEN 'Found results with unexpected release_label values: [''' || array_to_string(other_rel, ''', ''') || ''']' END,
    CASE WHEN want_kind IS NOT NULL AND len(other_kind) > 0 THEN 'Found results with unexpected source_kind values: [''' || array_to_string(other_kind, ''', ''') || ''']' END,
    CASE WHEN query_id // 100 % 2 = 1 AND NOT (contains(coalesce(t, ''), 'the ') OR contains(coalesce(t, ''), 'der ')) THEN 'None of the expected text markers were found: [''the '', ''der '']' END,
    CASE WHEN query_id // 100 % 6 = 0 AND n = 0 THEN 'Top-1 expectation could not be checked because no results were returned.'
         WHEN query_id // 100 % 6 = 0 AND NOT (contains(t1, 'zzz') OR contains(t1, 'it''s')) THEN 'Top-1 result did not contain expected text markers: [''zzz'', "it''s"]' END
  ], lambda x: x IS NOT NULL) AS failures FROM f)"""


def _evaluated(spark, sf) -> DataFrame:
    hits = T.hits(spark, sf).withColumn("case_id", F.col("query_id").cast("string"))
    return evaluation.evaluated(T.cases(spark, sf), hits)


@query(f"WITH {_CASE} SELECT query_id::VARCHAR AS case_id, len(failures) = 0 AS passed, expect AS expected_to_pass, (len(failures) = 0) = expect AS outcome_as_expected, n AS result_count, array_to_string(failures, '; ') AS failures FROM g")
def eval_cases(spark, sf):
    out = _evaluated(spark, sf)
    return out.select("case_id", "passed", "expected_to_pass", "outcome_as_expected", F.col("result_count").cast("long").alias("result_count"), F.array_join("failures", "; ").alias("failures"))


@query(f"WITH {_CASE} SELECT count(*) AS total_cases, count(*) FILTER (len(failures) = 0) AS passed_count, count(*) FILTER ((len(failures) = 0) = expect) AS expected_outcome_count FROM g")
def eval_report(spark, sf):
    return evaluation.report(_evaluated(spark, sf))


@query(f"""WITH {T.HIT_SQL}, t AS (SELECT query_id, any_value(query) AS query, count(point_id) AS n, max(score) AS top, string_agg(point_id, ',' ORDER BY rank) AS ids FROM qs LEFT JOIN hits USING (query_id) GROUP BY query_id)
  SELECT query, 'release_label=-,source_kind=table' AS filters, n >= 1 AND top >= 0.3 AS is_answered, CASE WHEN n >= 1 AND top >= 0.3 THEN first || ' [C1]' ELSE '{answer.REFUSAL}' END AS answer,
    CASE WHEN n < 1 THEN 'Expected at least 1 results, got 0.' WHEN top < 0.3 THEN 'Top score ' || top || ' is below required threshold 0.3.' END AS refusal_reason,
    n AS result_count, coalesce(ids, '') AS point_ids, true AS has_id, true AS has_time
  FROM t LEFT JOIN cited USING (query_id)""")
def answer_trace(spark, sf):
    """The traces but for their random ids and the time, of which only the form is told."""
    answers = answer.grounded_answers(T.vector_queries(spark, sf), T.hits(spark, sf))
    rows = trace.traces(answers, T.hits(spark, sf), filters={"release_label": None, "source_kind": "table"})
    told = F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    reply = F.col("answer_response")
    return rows.select(
        "query", F.array_join(told, ",").alias("filters"), reply["is_answered"].alias("is_answered"), reply["answer"].alias("answer"), reply["refusal_reason"].alias("refusal_reason"),
        F.size("retrieval_results").cast("long").alias("result_count"), F.array_join(F.transform("retrieval_results", lambda r: r["point_id"]), ",").alias("point_ids"),
        F.col("request_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("has_id"), F.col("created_at_utc").rlike(r"^\d{4}-\d\d-\d\dT[\d:.]+\+00:00$").alias("has_time"),
    )


@query("SELECT 'case-' || item_id AS case_id, text AS query, item_id % 3 = 0 AS expected_to_pass, 1 AS min_results, 'R' || (item_id % 25) AS release_label FROM benchmark")
def cases_file(spark, sf):
    """Evaluation cases written one a line, by the tasks that have them, and read back by the strict reader."""
    folder = T.scratch(spark)
    row = F.struct(
        F.concat(F.lit("case-"), "item_id").alias("case_id"), F.col("text").alias("query"), F.struct(F.concat(F.lit("R"), F.col("item_id") % 25).alias("release_label")).alias("filters"),
        F.struct((F.col("item_id") % 3 == 0).alias("expected_to_pass")).alias("expectation"),
    )
    T.table(spark, sf, "benchmark").select(F.to_json(row).alias("value")).write.text(folder + "/cases")
    cases = artifacts.read_cases(spark, folder + "/cases")
    return cases.select("case_id", "query", "expectation.expected_to_pass", "expectation.min_results", "filters.release_label")


def _counts():
    """A client on the executor: code points and blanks of each text."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("""SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS blanks FROM documents""")
def client_vectors(spark, sf):
    """Whole texts embedded by a client through a ledger of its responses, those of one language in an earlier run."""
    held = Ledger(spark, T.scratch(spark), "counts")
    provider = embedding.ClientProvider(_counts, held)
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    provider.embed(docs.where("lang = 'en'"), "text", "vector")
    made = provider.embed(docs, "text", "vector")
    return made.select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("blanks"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to cited decisions: units, keys, embedding, search for benchmark texts, sufficiency."""
    provider = embedding.HashProvider()
    once = embedding.last_wins(T.records(spark, sf_dir), ["document_name", "unit_index"])
    store = index.points(provider.embed(once, "text", "vector"), strict=False)
    asked = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return evidence.assess(asked, search.search_texts(store, asked, provider))
