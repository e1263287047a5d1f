"""Runs over a folder that grows: only what is new is opened, embedded and upserted."""

import pytest
from pyspark.sql import functions as F
from stratalens.operators import embedding, index
from stratalens.plans import pipelines
from stratalens.sources import docx, tables
from stratalens.sources.tables import Table


def put(folder, name, *paragraphs):
    (folder / name).write_bytes(docx.to_docx(list(paragraphs), []))


@pytest.fixture()
def run(spark, tmp_path):
    source = tmp_path / "specs [1] {a}"
    (source / "sub").mkdir(parents=True)
    put(source / "sub", "FS_Other_R1.docx", "Not of this folder.")
    store = index.Collection(spark, str(tmp_path / "store"), size=64)
    root, calls = str(tmp_path / "tables"), str(tmp_path / "calls")

    class Provider(embedding.HashProvider):
        """Tells which texts it was asked for."""

        def fill(self, rows, text, vector, missing):
            rows.where(missing).select(text).write.mode("append").parquet(calls)
            return super().fill(rows, text, vector, missing)

    def go(provider=None, at_once=10):
        return pipelines.follow(spark, str(source), root, str(tmp_path / "checkpoint"), provider or Provider(), store, at_once=at_once)

    go.source, go.store, go.root, go.texts = source, store, root, lambda: sorted(r.text for r in spark.read.parquet(calls).collect())
    go.table = lambda name: Table(spark, root, name).read()
    return go


def test_only_new_files(spark, run):
    assert run() == 0 and run.store.read().count() == 0
    put(run.source, "FS_Pay_R2.docx", "The branch code limit is ten.")
    put(run.source, "FS_Loan_R10.DOCX", "Loans are repaid monthly.")
    (run.source / "~$FS_Pay_R2.docx").write_bytes(b"x")
    (run.source / "notes.txt").write_text("x")
    assert run() == 1
    assert sorted(r.document_name for r in run.table(tables.DOCUMENTS).collect()) == ["FS_Loan_R10", "FS_Pay_R2"] and run.store.read().count() == 2
    # files that were read may go: a run over an unchanged folder opens none
    for name in ("FS_Pay_R2.docx", "FS_Loan_R10.DOCX"):
        (run.source / name).write_bytes(b"no archive")
    assert run() == 0
    put(run.source, "FS_Card_R1.docx", "Loans are repaid monthly.")
    put(run.source, "FS_Card_R3.docx", "Cards expire.")
    assert run() == 1
    # equal texts are one point, of the last document's record, as if all had been indexed at once
    points = lambda c: sorted((r.point_id, r.payload) for r in c.read().collect())
    whole = index.Collection(spark, run.store.path + "-whole", size=64)
    pipelines.index_tables(spark, run.root, whole)
    assert points(run.store) == points(whole) and len(points(whole)) == 3
    # the text of a known key is not asked for again
    assert run.texts() == ["Cards expire."]
    got = {r.document_name: r.embedding_status for r in run.table(tables.RECORDS).collect()}
    assert got == {"FS_Pay_R2": "embedded", "FS_Loan_R10": "embedded", "FS_Card_R1": "cached", "FS_Card_R3": "embedded"}
    assert run.table(tables.SUMMARIES).count() == run.table(tables.CHUNKS).count() == run.table(tables.UNITS).count() == 4


def test_a_failed_batch_is_done_again(spark, run):
    class Broken(embedding.HashProvider):
        def embed(self, rows, text, vector):
            return rows.withColumn(vector, F.raise_error(F.lit("out of service")).cast("array<double>"))

    for i in range(5):
        put(run.source, f"FS_D{i}_R1.docx", f"Text {'abcde'[i]} of it.")
    with pytest.raises(Exception, match="out of service"):
        run(Broken(), at_once=2)
    assert run(at_once=2) == 3 and run() == 0
    assert run.table(tables.RECORDS).where("vector IS NOT NULL").count() == run.store.read().count() == 5


def test_a_refused_name_stops_no_batch(spark, run):
    put(run.source, "FS_A_R1.docx", "A.")
    put(run.source, "_FS_B_R1.docx", "B.")
    with pytest.raises(Exception, match="Unsupported document filename"):
        run()
    (run.source / "_FS_B_R1.docx").unlink()
    assert run() == 1 and run.store.read().count() == 1


def test_listing(spark, run):
    for name in ("FS_A_R1.docx", "_a=b.docx", ".c.docx", "FS_[x]_R1.docx"):
        put(run.source, name, name)
    (run.source / "d.docx").mkdir()
    (run.source / "p=1").mkdir()
    put(run.source / "p=1", "FS_Z_R1.docx", "Z")
    rows = docx.listed(spark, str(run.source)).collect()
    assert sorted((r.file_name, r.content is None) for r in rows) == [(".c.docx", True), ("FS_A_R1.docx", False), ("FS_[x]_R1.docx", False), ("_a=b.docx", True)]
    assert [r.file_name for r in docx.listed(spark, str(run.source), "FS_[x]_R1.docx").collect()] == ["FS_[x]_R1.docx"]
    assert docx.listed(spark, str(run.source), "FS_a_R1.docx").count() == 0


def test_files_of_subfolders_stay_closed(spark, run, monkeypatch):
    """The files that a plan opens: of the folder itself, before any filter on rows."""
    put(run.source, "FS_A_R1.docx", "A.")
    rows = docx.listed(spark, str(run.source))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1, plan
