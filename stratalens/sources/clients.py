"""Clients of remote models that speak the common HTTP interface (``/embeddings``, ``/chat/completions``).

Each factory returns a function that makes the client on the executor, so nothing but settings is shipped.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from email.utils import parsedate_to_datetime

from stratalens.config import Settings

DEFAULT_URL = "https://api.openai.com/v1"
#: Texts sent in one request, and seconds to wait for its answer.
BATCH, TIMEOUT = 256, 120
#: How often a request is sent that fails for a reason that may pass, and the longest wait between, in seconds.
TRIES, LONGEST = 6, 300.0
#: Statuses of such reasons.
PASSING = (408, 409, 429, 500, 502, 503, 504)


def wait(after: str | None, tried: int) -> float:
    """Seconds to wait after ``tried`` failures: as the service says (seconds or a date), else twice as long each time, by chance up to half less."""
    try:
        asked = float(after)
    except (TypeError, ValueError):
        try:
            asked = parsedate_to_datetime(after).timestamp() - time.time()
        except (TypeError, ValueError):
            asked = 2.0 ** (tried - 1) * random.uniform(0.5, 1.0)
    return min(max(asked, 0.0), LONGEST)


def _post(settings: Settings, path: str, body: dict) -> dict:
    url = f"{(settings.base_url or DEFAULT_URL).rstrip('/')}/{path}"
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {settings.api_key}"}
    request = urllib.request.Request(url, json.dumps(body).encode("utf-8"), headers)
    for tried in range(1, TRIES + 1):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
                return json.loads(reply.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or tried == TRIES:
                raise
            after = e.headers.get("Retry-After")
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if tried == TRIES:
                raise
            after = None
        time.sleep(wait(after, tried))


def embeddings(settings: Settings) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """For ``ClientProvider``: texts to vectors, in the order asked for."""

    def connect():
        def client(texts: list[str]) -> list[list[float]]:
            out = []
            for at in range(0, len(texts), BATCH):
                data = _post(settings, "embeddings", {"model": settings.embedding_model, "input": texts[at : at + BATCH]})["data"]
                out += [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
            return out

        return client

    return connect


def chat(settings: Settings) -> Callable[[], Callable]:
    """For ``ChatClient``: (system, user) to (content, prompt tokens, completion tokens), or None without choices."""

    def connect():
        def client(system: str, user: str) -> tuple | None:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            reply = _post(settings, "chat/completions", {"model": settings.chat_model, "messages": messages})
            if not reply.get("choices"):
                return None
            usage = reply.get("usage") or {}
            return reply["choices"][0]["message"]["content"], usage.get("prompt_tokens"), usage.get("completion_tokens")

        return client

    return connect
