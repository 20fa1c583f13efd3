"""Embedders and language models behind HTTP: services that speak the widespread JSON forms for embeddings and chats.

Both are made inside a task from plain settings, so they can be handed to ``embedded`` and ``extract`` as factories
(``lambda: HttpModel(url, "small")``).
"""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Sequence

#: Seconds to wait for an answer. A model may think longer than an embedder.
EMBEDDING_SECONDS, ANSWER_SECONDS = 60, 120
#: Texts in one request.
TEXTS = 128


def post(url: str, body: dict, key: str | None, seconds: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), head, method="POST")
    with urllib.request.urlopen(request, timeout=seconds) as reply:
        return json.loads(reply.read())


class HttpEmbedder:
    """Unit vectors from a service: POST {model, input} gives {data: [{index, embedding}]}. Failures raise."""

    def __init__(self, url: str, model: str, dimension: int, key: str | None = None, seconds: float = EMBEDDING_SECONDS):
        self.url, self.model, self.dimension, self.key, self.seconds = url, model, dimension, key, seconds

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), TEXTS):
            part = list(texts[at : at + TEXTS])
            rows = post(self.url, {"model": self.model, "input": part}, self.key, self.seconds)["data"]
            found = [x["embedding"] for x in sorted(rows, key=lambda x: x["index"])]
            if len(found) != len(part) or any(len(v) != self.dimension for v in found):
                raise ValueError("the embedder's answer doesn't fit the question")
            out += [[x / (math.hypot(*v) or 1.0) for x in v] for v in found]
        return out


class HttpModel:
    """A chat service asked for a JSON object without randomness: POST {model, messages} gives {choices: [{message}]}."""

    def __init__(self, url: str, model: str, key: str | None = None, seconds: float = ANSWER_SECONDS):
        self.url, self.model, self.key, self.seconds = url, model, key, seconds

    def complete(self, prompt: str) -> str:
        body = {
            "model": self.model,
            "temperature": 0,
            "response_format": {"type": "json_object"},
            "messages": [{"role": "user", "content": prompt}],
        }
        return post(self.url, body, self.key, self.seconds)["choices"][0]["message"]["content"]
