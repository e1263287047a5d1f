import http.server
import json
import subprocess
import sys
import threading
import zipfile

import pytest
from pyspark.sql import functions as F
from stratalens.config import load_settings, shown
from stratalens.operators import embedding, index
from stratalens.plans import cli, pipelines
from stratalens.sources import artifacts, docx


@pytest.fixture()
def folder(tmp_path):
    src = tmp_path / "specs dir"
    src.mkdir()
    body = ["Document Control", "", " First rule ", "Second\tpart", "The branch code limit is ten."]
    (src / "FS_Pay_R2.docx").write_bytes(docx.to_docx(body, [[["Column", "Description"], ["Branch  Code", "Unique branch identifier"]]]))
    (src / "FS_Loan_R10_Draft.DOCX").write_bytes(docx.to_docx(["Loans are repaid monthly."], []))
    (src / "~$FS_Pay_R2.docx").write_bytes(b"x")
    (src / "notes.txt").write_text("x")
    (src / "sub").mkdir()
    return src


def test_docx(spark, folder):
    files = docx.discover(spark, str(folder))
    assert [r.file_name for r in files.collect()] == ["FS_Loan_R10_Draft.DOCX", "FS_Pay_R2.docx"]
    got = {r.document_name: r for r in docx.read(files).collect()}
    pay = got["FS_Pay_R2"]
    assert pay.paragraphs == ["Document Control", "", "First rule", "Second\tpart", "The branch code limit is ten."] and pay.non_empty_paragraph_count == 4
    assert pay.tables[0].text_representation == "Column | Description\nBranch Code | Unique branch identifier"
    assert got["FS_Loan_R10_Draft"].variant_suffix == "Draft"
    with pytest.raises(FileNotFoundError):
        docx.discover(spark, str(folder / "no"))
    with pytest.raises(ValueError):
        docx.read_file(spark, str(folder / "notes.txt"))
    with pytest.raises(FileNotFoundError):
        docx.read_file(spark, str(folder / "no.docx"))


def test_whole_path(spark, folder, tmp_path):
    provider, cache = embedding.HashProvider(), str(tmp_path / "cache")
    first = pipelines.embed_folder(spark, str(folder), cache, provider)
    assert {r.embedding_status for r in first.collect()} == {"embedded"}
    paths = artifacts.export_records(first, cache)
    held = json.loads(open(paths[0].removeprefix("file:"), encoding="utf-8").read())
    assert held["total_records"] == len(held["records"]) and held["cached_count"] == 0
    again = pipelines.embed_folder(spark, str(folder), cache, provider, document="FS_Pay_R2.docx", kind="table")
    assert [(r.embedding_status, r.source_kind) for r in again.collect()] == [("cached", "table")]
    store = index.Collection(spark, str(tmp_path / "store"), size=64)
    done = pipelines.index_cache(spark, cache, store).first()
    assert done.upserted_points == 3 and done.skipped_records == 0
    asked = spark.createDataFrame([("q", "branch code limit", None, "R2")], "query_id string, query string, document_family string, release_label string")
    answers, hits = pipelines.ask(store, asked, provider)
    r = answers.first()
    assert r.is_answered and "[C1]" in r.answer and {h.payload.release_label for h in hits.collect()} == {"R2"}
    store.build_cells()
    again = pipelines.ask(store, asked, provider, release_label="R2")[1]
    assert sorted((h["rank"], h.point_id, h.score) for h in again.collect()) == sorted((h["rank"], h.point_id, h.score) for h in hits.collect())
    assert pipelines.hits(store, asked, provider, source_kind="paragraph").count() == 1 and pipelines.hits(store, asked, provider, release_label="R1").count() == 0
    (path,) = pipelines.traced(answers, hits, str(tmp_path / "traces"), "req-1", {"release_label": "R2"})
    trace = json.loads(open(path.removeprefix("file:"), encoding="utf-8").read())
    assert path.endswith("req-1.json") and trace["filters"] == {"release_label": "R2"} and trace["answer_response"]["is_answered"]
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"case_id": "c", "query": "branch code", "expectation": {"expected_top1_contains_any": ["ranch"]}}]))
    totals, rows = pipelines.evaluate(store, artifacts.read_cases(spark, str(cases)), provider)
    report = json.loads(open(artifacts.export_report(totals, rows, str(tmp_path / "new" / "report.json")), encoding="utf-8").read())
    assert report["passed_count"] == report["total_cases"] == 1 and report["cases"][0]["case"]["case_id"] == "c"


def test_cases_are_strict(spark, tmp_path):
    path = tmp_path / "cases.json"
    for bad, kind in (([{"query": "q"}], KeyError), ([{"case_id": "c", "query": "q", "filters": {"color": "x"}}], TypeError)):
        path.write_text(json.dumps(bad))
        with pytest.raises(kind):
            artifacts.read_cases(spark, str(path))
    assert artifacts.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_settings(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nVECTOR_SIZE=64\nUNKNOWN=1\nchat_model='m'\n")
    monkeypatch.setenv("VECTOR_SIZE", "32")
    got = load_settings(env)
    assert (got.vector_size, got.chat_model, got.retrieval_min_top_score) == (32, "m", 0.30)


def test_the_key_is_neither_shown_nor_taken_from_others(tmp_path, monkeypatch):
    monkeypatch.setenv("API_KEY", "another program's")
    monkeypatch.setenv("BASE_URL", "http://another")
    assert (load_settings(tmp_path / "none").api_key, load_settings(tmp_path / "none").base_url) == ("", "")
    monkeypatch.setenv("STRATALENS_API_KEY", "secret-key")
    got = load_settings(tmp_path / "none")
    assert got.api_key == "secret-key" and "secret-key" not in f"{got!r}{got}{shown(got)}" and "(set)" in shown(got)


@pytest.mark.parametrize("command", ["ingest", "embed", "embed-tables", "follow", "index", "search", "answer", "evaluate", "inspect", "check-setup"])
def test_help(command):
    done = subprocess.run([sys.executable, "-m", "stratalens.plans.cli", command, "--help"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "usage" in done.stdout


def test_merged_cells(spark, tmp_path):
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    rows = [cell("a", '<w:vMerge w:val="restart"/>') + cell("b"), cell("", "<w:vMerge/>") + cell("c"), cell("d", '<w:gridSpan w:val="2"/>'), cell("", '<w:vMerge w:val="continue"/>') + cell("e")]
    body = "".join(f"<w:tr>{r}</w:tr>" for r in rows)
    path = tmp_path / "FS_M_R1.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    assert docx.parse(path.read_bytes())[1] == [[["a", "b"], ["a", "c"], ["d", "d"], ["d", "e"]]]


def test_a_paragraph_has_the_text_of_its_own_runs(tmp_path):
    run = lambda x: f"<w:r>{x}</w:r>"
    t = lambda x: f"<w:t>{x}</w:t>"
    box = f"<w:pict><w:txbxContent><w:p>{run(t('BOX'))}</w:p></w:txbxContent></w:pict>"
    body = run(t("outer") + box + t(" x")) + '<w:r><w:br w:type="page"/><w:t>y</w:t><w:br/><w:tab/><w:noBreakHyphen/></w:r>' + f"<w:ins>{run(t('INS'))}</w:ins><w:hyperlink>{run(t('link'))}</w:hyperlink>{run(t('.'))}"
    path = tmp_path / "FS_P_R1.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body><w:p>{body}</w:p></w:body></w:document>')
    assert docx.parse(path.read_bytes())[0] == ["outer xy\n\t-link."]


def test_only_documents_are_opened(spark, folder):
    (folder / "_FS_Hid_R1.docx").write_bytes(docx.to_docx(["x"], []))
    assert sorted(r.file_name for r in docx.loaded(docx.discover(spark, str(folder))).collect()) == ["FS_Loan_R10_Draft.DOCX", "FS_Pay_R2.docx", "_FS_Hid_R1.docx"]
    with pytest.raises(Exception, match="Unsupported document filename"):
        docx.read(docx.discover(spark, str(folder))).collect()
    (folder / "empty").mkdir()
    assert docx.read(docx.discover(spark, str(folder / "empty"))).count() == 0


def test_export_names(spark, tmp_path):
    rows = spark.createDataFrame([("a b=c%", 1), ("é x", 2)], "name string, n int")
    paths = artifacts.export(rows, str(tmp_path / "out"), "name", ".json")
    artifacts.export(rows.withColumn("n", F.col("n") + 1), str(tmp_path / "out"), "name", ".json")
    assert [json.loads(open(p.removeprefix("file:"), encoding="utf-8").read()) for p in paths] == [{"name": "a b=c%", "n": 2}, {"name": "é x", "n": 3}]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix != ".crc") == ["a b=c%.json", "é x.json"]


class Model(http.server.BaseHTTPRequestHandler):
    """A remote model that counts its calls."""

    calls: list = []

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Model.calls.append((self.path, self.headers["Authorization"], asked))
        if self.path.endswith("/embeddings"):
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked["input"])][::-1]}
        else:
            out = {"choices": [{"message": {"content": f" reply {len(Model.calls)} [C1] "}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}
        body = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_remote_models_are_called_once(spark, folder, tmp_path, monkeypatch, capsys):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("STRATALENS_BASE_URL", f"http://127.0.0.1:{server.server_port}/v1")
    monkeypatch.setenv("STRATALENS_API_KEY", "k")
    monkeypatch.setenv("VECTOR_SIZE", "2")
    cache, store, traces = (str(tmp_path / n) for n in ("cache", "store", "traces"))
    cli.main(["embed", "--source", str(folder), "--cache", cache, "--units", "9", "--provider", "remote"])
    texts = [t for path, _, asked in Model.calls for t in asked["input"]]
    assert len(texts) == len(set(texts)) == 3 and {key for _, key, _ in Model.calls} == {"Bearer k"}
    Model.calls.clear()
    cli.main(["embed", "--source", str(folder), "--cache", cache, "--units", "9", "--provider", "remote"])
    assert not Model.calls
    cli.main(["index", "--cache", cache, "--store", store])
    capsys.readouterr()
    cli.main(["answer", "--store", store, "--query", "what limit", "--trace-dir", traces, "--provider", "remote"])
    assert sorted(path for path, *_ in Model.calls) == ["/v1/chat/completions", "/v1/embeddings"]
    (path,) = [p for p in (tmp_path / "traces").iterdir() if p.suffix == ".json"]
    said, traced = capsys.readouterr().out, json.loads(path.read_text(encoding="utf-8"))
    assert traced["answer_response"]["answer"] in said and traced["answer_response"]["answer"].startswith("reply ")
    server.shutdown()


def test_cases_of_both_forms(spark, tmp_path):
    """An array in a file and lines in a folder are the same cases; defaults stand for keys that are absent, not for nulls."""
    cases = [
        {"case_id": "b", "query": "é\nq", "filters": {"release_label": "R1"}, "expectation": {"min_results": 3, "expected_text_contains_any": ["x", "y"]}, "notes": "n", "more": 1},
        {"case_id": "a", "query": "", "expectation": {"expected_to_pass": None}},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=1), encoding="utf-8")
    (tmp_path / "lines").mkdir()
    for i, c in enumerate(cases):
        (tmp_path / "lines" / f"{i}.json").write_text(json.dumps(c), encoding="utf-8")
    one, many = (artifacts.read_cases(spark, str(tmp_path / n)).orderBy("case_id").collect() for n in ("cases.json", "lines"))
    assert one == many and [r.case_id for r in one] == ["a", "b"]
    a, b = (r.asDict(recursive=True) for r in one)
    assert a["expectation"] == artifacts.EXPECTATION | {"expected_to_pass": None} and a["filters"] == artifacts.FILTERS and a["notes"] == ""
    assert b["expectation"] == artifacts.EXPECTATION | cases[0]["expectation"] and b["filters"]["release_label"] == "R1" and b["query"] == "é\nq"
    (tmp_path / "cases.json").write_text("[]")
    assert artifacts.read_cases(spark, str(tmp_path / "cases.json")).count() == 0
    (tmp_path / "cases.json").write_text('[{"case_id": "c", "query": "q", "expectation": {"min_results": "many"}}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        artifacts.read_cases(spark, str(tmp_path / "cases.json")).collect()


def test_report_is_one_indented_file(spark, tmp_path):
    cases = spark.range(0, 3000, 1, 7).selectExpr(
        "format_string('c%05d', 2999 - id) AS case_id", "concat('q\n', id) AS query", "CAST(NULL AS STRING) AS filters", "'e' AS expectation", "'' AS notes",
        "true AS passed", "true AS expected_to_pass", "true AS outcome_as_expected", "0 AS result_count", "array('é') AS failures", "array() AS hits",
    )
    totals = spark.createDataFrame([(3000, 3000)], "total_cases long, passed_count long")
    for rows, n in ((cases, 3000), (cases.limit(0), 0)):
        text = open(artifacts.export_report(totals, rows, str(tmp_path / "a" / "r.json")), encoding="utf-8").read()
        body = json.loads(text)
        assert text == json.dumps(body, indent=2, ensure_ascii=False)
        assert list(body) == ["total_cases", "passed_count", "cases"] and [c["case"]["case_id"] for c in body["cases"]] == [f"c{i:05d}" for i in range(n)]
    assert [p.name for p in (tmp_path / "a").iterdir() if p.suffix != ".crc"] == ["r.json"]
