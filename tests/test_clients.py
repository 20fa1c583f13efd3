import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomwork.operators import extract, vectors
from loomwork.operators.clients import HttpEmbedder, HttpModel


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.seen.append((self.path, body, self.headers.get("Authorization")))
        if self.path == "/embed":
            rows = [{"index": i, "embedding": [float(len(t)), 3.0]} for i, t in enumerate(body["input"])]
            answer = {"data": rows[::-1]}
        elif self.path == "/short":
            answer = {"data": [{"index": 0, "embedding": [1.0]}]}
        else:
            text = body["messages"][0]["content"].split("Text:\n")[1]
            content = "not JSON" if text.startswith("bad") else json.dumps({"size": len(text), "mood": "calm"})
            answer = {"choices": [{"message": {"content": content}}]}
        data = json.dumps(answer).encode()
        self.send_response(500 if self.path == "/broken" else 200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_embedder(spark, base):
    model = HttpEmbedder(f"{base}/embed", "small", 2, key="k")
    got = model.embed(["a" * (i % 7) for i in range(300)])
    assert len(got) == 300 and all(abs(math.hypot(*v) - 1) < 1e-9 for v in got) and got[4] == [4 / 5, 3 / 5]
    assert Stub.seen[-1][2] == "Bearer k" and max(len(x[1]["input"]) for x in Stub.seen) == 128
    with pytest.raises(ValueError):
        HttpEmbedder(f"{base}/short", "small", 2).embed(["a", "b"])
    d = spark.createDataFrame([(1, "abcd"), (2, " "), (3, None)], "i long, t string")
    url = f"{base}/embed"
    out = {x.i: x.vector for x in vectors.embedded(d, "t", lambda: HttpEmbedder(url, "small", 2)).collect()}
    assert [round(x, 5) for x in out[1]] == [0.8, 0.6] and out[2] is None and out[3] is None


def test_model(spark, base):
    d = spark.createDataFrame([(1, "good text"), (2, "bad text"), (3, "good text"), (4, None)], "i long, t string")
    url, before = f"{base}/chat", len(Stub.seen)
    own = [extract.Attribute("size", "long"), extract.Attribute("mood")]
    out = {x.i: (x["size"], x.mood) for x in extract.extract(d, "t", own, lambda: HttpModel(url, "small")).collect()}
    assert out == {1: (9, "calm"), 2: (None, None), 3: (9, "calm"), 4: (None, None)}
    asked = [x for x in Stub.seen[before:] if x[0] == "/chat"]
    assert len(asked) == 2 and asked[0][1]["temperature"] == 0 and asked[0][1]["response_format"] == {"type": "json_object"}
    broken = extract.extract(d, "t", own, lambda: HttpModel(url.replace("chat", "broken"), "small", seconds=5)).collect()
    assert all(x.mood is None for x in broken)  # a failed call is a missing value
