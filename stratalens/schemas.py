"""Schemas of the records that stages exchange, as DDL."""

TABLES = "array<array<array<string>>>"
CITATION = "struct<unit_id:string,document_family:string,release_label:string,source_kind:string,score:double,text_preview:string>"
UNIT = "unit_id string, unit_index int, source_kind string, text string, document_family string, release_label string"
RECORD_FIELDS = (
    "unit_id string, unit_index int, source_kind string, document_family string, release_label string, content_hash string, "
    "artifact_version string, cache_key string, text string, embedding_model string, embedding_status string, vector array<double>"
)
RECORD_ARTIFACT = (
    "document_name string, total_records int, cached_count int, embedded_count int, cache_miss_count int, "
    f"records array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in RECORD_FIELDS.split(', '))}>>"
)
#: Fields of a point's payload.
PAYLOAD = (
    "unit_id", "unit_index", "source_kind", "document_family", "release_label", "content_hash", "artifact_version", "cache_key",
    "embedding_model", "embedding_status", "text",
)
POINT = (
    "point_id string, vector array<double>, unit_vector array<double>, payload struct<"
    + ", ".join(f"{c}:{'int' if c == 'unit_index' else 'string'}" for c in PAYLOAD) + ">"
)
EVAL_CASE = (
    "case_id string, query string, filters struct<document_family:string,release_label:string,source_kind:string>, "
    "expectation struct<expected_to_pass:boolean,min_results:int,expected_release_label:string,expected_source_kind:string,"
    "expected_top1_contains_any:array<string>,expected_text_contains_any:array<string>>, notes string"
)
