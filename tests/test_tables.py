import pytest
from pyspark.sql import functions as F

from stratalens.operators import embedding, index, search
from stratalens.plans import pipelines
from stratalens.sources import docx, tables

SCHEMA = "document_name string, document_family string, release_label string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_rerun_replaces_only_its_documents(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path), "t")
    with pytest.raises(FileNotFoundError):
        t.read()
    first = [("a", "F", "1", 1), ("a", "F", "1", 2), ("b", "F", "1", 3), ("c", "F", "2", 4), ("d", "G", None, 5), ("e", "G=x/y", "07", 6)]
    t.write(spark.createDataFrame(first, SCHEMA))
    assert rows(t.read()) == sorted(first, key=repr)
    untouched = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("_release=2/*.parquet")}
    again = [("a", "F", "1", 10), ("d", "G", "3", 50)]  # one is shorter, one moves to another release
    t.write(spark.createDataFrame(again, SCHEMA))
    want = [r for r in first if r[0] not in "ad"] + again
    assert rows(t.read()) == sorted(want, key=repr)
    assert untouched and untouched == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("_release=2/*.parquet")}
    t.write(spark.createDataFrame(again, SCHEMA))
    assert rows(t.read()) == sorted(want, key=repr)
    assert rows(t.read("F", "1")) == [("a", "F", "1", 10), ("b", "F", "1", 3)] and rows(t.read(release_label="07")) == [first[5]]
    t.write(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("e",), ("none",)], "document_name string"))
    assert rows(t.read()) == sorted((r for r in want if r[0] != "e"), key=repr)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path), "t")
    first = [("a", "F", "1", 1), ("b", "F", "1", 2)]
    t.write(spark.createDataFrame(first, SCHEMA))
    with pytest.raises(Exception, match="lost"):
        t.write(spark.createDataFrame(first, SCHEMA).withColumn("n", F.raise_error(F.lit("lost")).cast("int")))
    assert rows(t.read()) == first


def test_stages_read_the_tables_before_them(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "tables")
    folder.mkdir()
    (folder / "FS_Loan_R10.docx").write_bytes(docx.to_docx(["loan limits apply here", "branch code rules"], [[["Column", "Description"], ["Code", "identifier"]]]))
    (folder / "FS_Pay_R2.docx").write_bytes(docx.to_docx(["payment rules"], []))
    provider = embedding.HashProvider()
    pipelines.ingest_tables(spark, str(folder), root)
    units = tables.Table(spark, root, tables.UNITS).read()
    assert {(r.document_name, r.source_kind) for r in units.collect()} == {("FS_Loan_R10", "paragraph"), ("FS_Loan_R10", "table"), ("FS_Pay_R2", "paragraph")}
    assert tables.Table(spark, root, tables.CHUNKS).read().count() == 2 and tables.Table(spark, root, tables.DOCUMENTS).read().count() == 2
    first = {r.document_name: (r.cached_count, r.embedded_count) for r in pipelines.embed_tables(spark, root, provider).collect()}
    assert first == {"FS_Loan_R10": (0, 2), "FS_Pay_R2": (0, 1)}
    # a rerun over one changed file replaces its document and embeds its misses only
    only = tmp_path / "changed"
    only.mkdir()
    (only / "FS_Loan_R10.docx").write_bytes(docx.to_docx(["new text"], [[["Column", "Description"], ["Code", "identifier"]]]))
    pipelines.ingest_tables(spark, str(only), root)
    again = {r.document_name: (r.cached_count, r.embedded_count) for r in pipelines.embed_tables(spark, root, provider).collect()}
    assert again == {"FS_Loan_R10": (1, 1), "FS_Pay_R2": (1, 0)}
    store = index.Collection(spark, str(tmp_path / "store"), size=provider.size, buckets=2)
    assert pipelines.index_tables(spark, root, store).first().upserted_points == 3
    asked = spark.createDataFrame([("q", "new text")], "query_id string, query string")
    assert search.search_texts(store.read(), asked, provider, 1).first().payload.text == "new text"
