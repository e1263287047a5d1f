"""Paid calls are made once: responses kept by key, attempts after a lost one, failures that pass."""

import http.server
import json
import threading
import time
import urllib.error
from email.utils import formatdate

import pandas as pd
import pytest
from pyspark.sql import functions as F
from stratalens.config import Settings
from stratalens.operators import answer, embedding
from stratalens.sources import clients, ledger


class Service(http.server.BaseHTTPRequestHandler):
    """Counts texts answered, and fails as told: statuses by number of the call."""

    answered: list = []
    failures: dict = {}
    calls = 0
    lock = threading.Lock()

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with Service.lock:
            Service.calls += 1
            status = Service.failures.get(Service.calls, 200)
            if status == 200:
                Service.answered += asked["input"] if "input" in asked else [asked["messages"][1]["content"]]
        self.send_response(status)
        if status != 200:
            self.send_header("Retry-After", "0")
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        if "input" in asked:
            out = {"data": [{"index": i, "embedding": [len(t) / 3, 1.0]} for i, t in enumerate(asked["input"])]}
        else:
            out = {"choices": [{"message": {"content": f"reply {Service.calls} [C1]"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}
        body = json.dumps(out).encode()
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture()
def settings():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.answered, Service.failures, Service.calls = [], {}, 0
    yield Settings(api_key="k", base_url=f"http://127.0.0.1:{server.server_port}/v1")
    server.shutdown()


def vectors(df):
    return sorted((r.id, r.vector) for r in df.collect())


def test_texts_are_sent_once(spark, settings, tmp_path):
    held = ledger.Ledger(spark, str(tmp_path / "ledger"), "m")
    provider = embedding.ClientProvider(clients.embeddings(settings), held)
    rows = spark.range(500).select("id", F.concat(F.lit("é text "), F.col("id") % 300).alias("text"))
    want = [(i, [len(f"é text {i % 300}") / 3, 1.0]) for i in range(500)]
    made = provider.embed(rows, "text", "vector")
    assert vectors(made) == vectors(made) == want
    assert len(Service.answered) == len(set(Service.answered)) == 300
    assert vectors(provider.embed(rows, "text", "vector")) == want and len(Service.answered) == 300
    more = rows.unionByName(spark.createDataFrame([(900, "")], rows.schema))
    assert vectors(provider.embed(more, "text", "vector")) == [*want, (900, [0.0, 1.0])] and len(Service.answered) == 301
    held.vacuum()
    assert held.read().count() == 301 and len(held._folders("steps")) == 1 and not held._folders("runs")
    assert vectors(provider.embed(more, "text", "vector"))[-1] == (900, [0.0, 1.0]) and len(Service.answered) == 301
    other = embedding.ClientProvider(clients.embeddings(settings), ledger.Ledger(spark, held.path, "another model"))
    assert vectors(other.embed(rows.limit(1), "text", "vector")) == want[:1] and len(Service.answered) == 302
    assert provider.embed(rows.limit(0), "text", "vector").count() == 0


def test_only_misses_are_sent(spark, settings, tmp_path):
    provider = embedding.ClientProvider(clients.embeddings(settings), ledger.Ledger(spark, str(tmp_path / "ledger")))
    rows = spark.createDataFrame([(1, "abc", True, None, 7), (2, "abcdef", False, [5.0], 8), (3, "abc", True, None, 9)], "id int, text string, miss boolean, vector array<double>, key int")
    got = provider.fill(rows, "text", "vector", "miss")
    assert got.columns == ["id", "text", "miss", "key", "vector"] and vectors(got) == [(1, [1.0, 1.0]), (2, [5.0]), (3, [1.0, 1.0])]
    assert Service.answered == ["abc"]


def test_a_failed_run_is_continued(spark, settings, tmp_path):
    """The service refuses for good half-way: the next run sends only what no response was written for."""
    provider = embedding.ClientProvider(clients.embeddings(settings), ledger.Ledger(spark, str(tmp_path / "ledger")))
    rows = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    Service.failures = {n: 403 for n in range(9, 1000)}
    with pytest.raises(Exception, match="403"):
        vectors(provider.embed(rows, "text", "vector"))
    paid = len(Service.answered)
    assert 0 < paid < 1000
    Service.failures = {}
    assert len(vectors(provider.embed(rows, "text", "vector"))) == 1000
    assert len(Service.answered) == len(set(Service.answered)) == 1000


def test_an_attempt_after_a_lost_one(tmp_path):
    """A task that dies half-way; its next attempt, with rows in another order, asks for the rest only."""
    asked = []

    def client(requests):
        if len(asked) + len(requests) > 25 and not client.mended:
            raise ConnectionError
        asked.extend(requests)
        return [r.upper() for r in requests]

    client.mended = False
    rows = pd.DataFrame([(b, f"{b}-{i}", f"r{b}-{i}") for b in (0, 3) for i in range(20)], columns=["bucket", "key", "request"])
    task = ledger.asker(lambda: client, f"file://{tmp_path}/run", 10)
    with pytest.raises(ConnectionError):
        list(task(iter([rows[:15], rows[15:]])))
    assert len(asked) == 20 and ledger.written(f"file://{tmp_path}/run/0") == {f"0-{i}" for i in range(20)}
    client.mended = True
    sent = pd.concat(task(iter([rows[::-1]])))["sent"].sum()
    assert sent == 20 and len(asked) == len(set(asked)) == 40


def test_a_wrong_number_of_responses_fails(tmp_path):
    rows = pd.DataFrame([(0, "k", "r")], columns=["bucket", "key", "request"])
    with pytest.raises(RuntimeError, match="count mismatch"):
        list(ledger.asker(lambda: lambda requests: [], f"file://{tmp_path}/run", 10)(iter([rows])))
    assert not ledger.written(f"file://{tmp_path}/run/0")


def test_prompts_are_sent_once(spark, settings, tmp_path):
    chat = answer.ChatClient(clients.chat(settings), "m", ledger.Ledger(spark, str(tmp_path / "ledger")))
    rows = spark.createDataFrame([(i, "s", f"user {i % 6}\n ") for i in range(20)], "query_id int, system_prompt string, user_prompt string")
    Service.failures = {2: 429, 3: 503}
    first = sorted(map(tuple, chat.complete(rows).collect()))
    assert len(first) == 20 and len(Service.answered) == len(set(Service.answered)) == 6 and Service.calls == 8
    assert sorted(map(tuple, chat.complete(rows).collect())) == first and len(Service.answered) == 6
    assert first[0][-1].asDict() == {"model": "m", "prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7}
    assert len({r[3] for r in first}) == 6


def test_waits(settings, monkeypatch):
    assert clients.wait("7", 1) == 7.0 and clients.wait("1e9", 1) == clients.LONGEST and clients.wait("-3", 1) == 0.0
    assert 50 < clients.wait(formatdate(time.time() + 60, usegmt=True), 1) <= 60
    for tried in (1, 2, 5):
        assert 2 ** (tried - 1) / 2 <= clients.wait(None, tried) <= 2 ** (tried - 1) and clients.wait("soon", tried) > 0
    monkeypatch.setattr(clients.time, "sleep", lambda s: None)
    Service.failures = {n: 429 for n in range(1, 100)}
    with pytest.raises(urllib.error.HTTPError):
        clients.embeddings(settings)()(["x"])
    assert Service.calls == clients.TRIES
    Service.calls, Service.failures = 0, {1: 400}
    with pytest.raises(urllib.error.HTTPError):
        clients.embeddings(settings)()(["x"])
    assert Service.calls == 1
