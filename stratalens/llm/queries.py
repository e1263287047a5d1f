"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm.common import table


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1) AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*((?:/[^?#]*)?)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, '.' || host || path AS canon,
         CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN canon LIKE '%/login%' OR canon LIKE '%/cart%' OR regexp_matches(canon, '^[^/]*\.ads\.')
              OR regexp_matches(canon, '^[^/]*\.tracker\.') OR canon LIKE '%.exe' OR canon LIKE '%.zip'
              OR canon LIKE '%/wp-admin/%' THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

#: CRC-32 by a table of 256 made from its polynomial: common table expressions, and the value of a text's bytes.
_HALVED = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
CRC_TABLE_SQL = (
    "crc0 AS (SELECT range::BIGINT AS i, range::BIGINT AS c FROM range(256)), "
    + ", ".join(f"crc{k + 1} AS (SELECT i, {_HALVED} AS c FROM crc{k})" for k in range(8))
    + ", crcs AS (SELECT list(c ORDER BY i) AS tab FROM crc8)"
)
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])))"""

OP11_SQL = f"""
WITH {CRC_TABLE_SQL}, sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {CRC_SQL.format("coalesce(text, '')")} AS text_crc32 FROM documents, crcs
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) - size + size // 2 AS middle, sum(size) OVER () // 16 AS q, sum(size) OVER () % 16 AS r FROM sized
), cut AS (
  SELECT *, (CASE WHEN middle < r * (q + 1) THEN middle // (q + 1) ELSE r + (middle - r * (q + 1)) // greatest(q, 1) END)::INT AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""

# op12: a state is a string of ten digits of cost and the audit, '~' if it can't be reached; a layer is the list of the states' strings
_ADD = "CASE WHEN {0} = '~' THEN '~' ELSE lpad((left({0}, 10)::BIGINT + {1})::VARCHAR, 10, '0') || substr({0}, 11) || '{2}' END"
_I = lambda s: _ADD.format(s, 5, "I")
_CLOSED_ONCE = f"[c[1], c[2], least(c[3], {_I('c[1]')}, {_I('c[2]')}, {_I('c[4]')}), least(c[4], {_I('c[3]')})]"
_CLOSED = f"list_transform(list_transform([{{0}}], lambda c: {_CLOSED_ONCE}), lambda c: {_CLOSED_ONCE})"
_KEPT = lambda s, more: f"CASE WHEN x[2] = 'x' THEN '~' WHEN x[2] = 't' THEN {_ADD.format(s, more + 5, 'R' if more else 'K')} ELSE {_ADD.format(s, more, 'R' if more else 'K')} END"
_IF = lambda initial, s: f"CASE WHEN x[1] = '{initial}' THEN {_KEPT(s, 0)} ELSE '~' END"
_D = lambda s: _ADD.format(s, 2, "D")
_LAYER = f"""[{_D('c[1]')}, least({_D('c[2]')}, {_IF('s', 'c[1]')}),
  least({_D('c[3]')}, {', '.join(f"{_KEPT(s, 1)}, {_IF('u', s)}" for s in ('c[1]', 'c[2]', 'c[4]'))}), least({_D('c[4]')}, {_KEPT('c[3]', 1)}, {_IF('a', 'c[3]')})]"""
OP12_SQL = rf"""
WITH {CRC_TABLE_SQL}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crcs
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS n FROM damaged
), judged AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
         CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed)
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
         list([initial, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN 't' ELSE '.' END, '', ''] ORDER BY n) AS codes
  FROM judged GROUP BY conv_id
), passed AS (
  SELECT *, {_CLOSED.format("list_reduce(list_prepend(['0000000000', '~', '~', '~'], codes), lambda layer, x: list_transform(" + _CLOSED.format('layer') + ", lambda c: " + _LAYER + ")[1])")}[1] AS ends FROM counted
), ended AS (
  SELECT * EXCLUDE (codes, ends), left(least(ends[1], ends[4]), 10)::BIGINT AS cost, substr(least(ends[1], ends[4]), 11) AS audit FROM passed
), letters AS (
  SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS k, unnest(string_split(audit, '')) AS letter FROM ended WHERE audit <> ''
), steps AS (
  SELECT *, sum((letter <> 'I')::INT) OVER upto AS n, sum((letter <> 'D')::INT) OVER upto AS p FROM letters WINDOW upto AS (PARTITION BY conv_id ORDER BY k)
), edits AS (
  SELECT s.conv_id, k, p, letter, role, text, first_value(CASE WHEN letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id ORDER BY k) AS lead
  FROM steps s LEFT JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.n = j.n AND letter <> 'I' WHERE letter <> 'D'
), fixed AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said FROM edits GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN fixed f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
"""

OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS uid
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.uid <> b.uid AND len(a.v) = len(b.v)
), positives AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS positive_rank FROM pairs WHERE same QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY uid, positive_rank ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank::INT AS positive_rank
FROM positives p JOIN pairs n USING (uid) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.simhash import digest

    return digest(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.mixing import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.secret_scan import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.packing import digest, near_clusters

    docs = table(spark, sf_dir, "documents")
    return digest(docs, near_clusters(docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.line_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.url_filter import digest

    return digest(table(spark, sf_dir, "pages"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.lcp import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.collisions import digest

    return digest(table(spark, sf_dir, "embeddings"))


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op11_global_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.sharding import digest

    return digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.conversations import digest

    return digest(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalens.llm.negatives import digest

    return digest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_classifier, op3_source_mix, op4_secret_scan, op5_best_fit_packing, op6_line_dedup, op7_url_filter, op8_document_fingerprints, op9_embedding_near_dedup, op10_private_data, op11_global_byte_shards, op12_conversation_repair, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op11_global_byte_shards": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_hard_negatives": OP13_SQL}
