import json
import pickle
import sys
import threading
import types
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessella import providers
from tessella.models import embed
from tessella.operators import extraction


@pytest.fixture(scope="module")
def server():
    asked, busy = [], [0]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            asked.append((self.path, dict(self.headers.items()), body))
            code, text = 200, body.get("input") or body["messages"][0]["content"]
            if busy[0]:
                busy[0] -= 1
                code, out = 503, {"error": "busy"}
            elif text == "bad":
                code, out = 400, {"error": {"message": "no such thing"}}
            elif text == "wrong":
                out = {"error": {"message": "inside"}}
            elif text == "empty":
                out = {"choices": [], "data": []}
            elif "/chat/completions" in self.path:
                out = {"choices": [{"message": {"content": "said " + text}}]}
            elif "/embeddings" in self.path:
                out = {"data": [{"embedding": [1, len(text)]}]}
            elif self.path == "/api/chat":
                out = {"message": {"content": "said " + text}}
            elif self.path == "/api/embed":
                out = {"embeddings": [[2, len(text)]]}
            else:
                out = {"content": [{"type": "text", "text": "said "}, {"type": "tool_use"}, {"type": "text", "text": text}]}
            raw = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("content-length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked, busy
    s.shutdown()


def made(kind, provider, url, **options):
    where = {"endpoint": url} if provider == "azure_openai" else {"base_url": url}
    return getattr(providers, kind)(provider, "m 1", api_key="k", pause=0.0, **where, **options)


@pytest.mark.parametrize("provider, path, header", [
    ("openai", "/chat/completions", ("authorization", "Bearer k")), ("openrouter", "/chat/completions", ("authorization", "Bearer k")),
    ("azure_openai", "/openai/deployments/m%201/chat/completions?api-version=2024-06-01", ("api-key", "k")), ("ollama", "/api/chat", ("authorization", "Bearer k")), ("anthropic", "/v1/messages", ("x-api-key", "k")),
])
def test_chats(server, provider, path, header):
    url, asked, busy = server
    model = pickle.loads(pickle.dumps(made("chat", provider, url, params={"temperature": 0})))
    busy[0] = 2
    assert model.invoke("hello", top_p=1) == "said hello"
    at, headers, body = asked[-1]
    assert at == path and {k.lower(): v for k, v in headers.items()}[header[0]] == header[1]
    assert body["model"] == "m 1" and body["temperature"] == 0 and body["top_p"] == 1 and body["messages"] == [{"role": "user", "content": "hello"}]
    for text, said in (("bad", "no such thing"), ("wrong", "inside")):
        with pytest.raises(providers.ProviderError, match=said):
            model.invoke(text)
    busy[0] = 100
    with pytest.raises(providers.ProviderError, match="503"):
        model.invoke("hello")
    busy[0] = 0


@pytest.mark.parametrize("provider, first", [("openai", 1.0), ("openrouter", 1.0), ("azure_openai", 1.0), ("ollama", 2.0)])
def test_embedders(server, provider, first):
    model = pickle.loads(pickle.dumps(made("embedder", provider, server[0])))
    assert model.embed("hello") == [first, 5.0]
    with pytest.raises(providers.ProviderError):
        model.embed("bad")


def test_answers_without_their_part(server):
    with pytest.raises(providers.ProviderError, match="choices"):
        made("chat", "openai", server[0]).invoke("empty")
    with pytest.raises(providers.ProviderError, match="data"):
        made("embedder", "openai", server[0]).embed("empty")


def test_no_server_and_no_provider():
    with pytest.raises(providers.ProviderError, match="reached"):
        providers.chat("ollama", "m", base_url="http://127.0.0.1:9", pause=0.0).invoke("x")
    for make in (providers.chat, providers.embedder):
        with pytest.raises(ValueError, match="there are"):
            make("nobody", "m")


def test_sentence_transformers(monkeypatch):
    model = providers.embedder("sentence-transformer", "tiny", device="cpu")
    with pytest.raises(ImportError):
        model.embed("x")
    own = types.ModuleType("sentence_transformers")
    own.SentenceTransformer = lambda name, device: types.SimpleNamespace(encode=lambda texts, **p: [[len(t), len(name)] for t in texts])
    monkeypatch.setitem(sys.modules, "sentence_transformers", own)
    assert model.embed("abc") == [3.0, 4.0]
    assert pickle.loads(pickle.dumps(model)).model == "tiny"


def test_in_workers(spark, server):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string")
    got = {r.t: (r.content, r.error) for r in extraction.call(df, F.col("t"), made("chat", "anthropic", server[0])).collect()}
    assert got["a"] == ("said a", None) and got[None] == (None, None) and "no such thing" in got["bad"][1]
    got = {r.t: (r.embedding, r.embed_error) for r in embed(df, F.col("t"), made("embedder", "ollama", server[0])).collect()}
    assert got["a"] == ([2.0, 1.0], None) and got[None] == (None, None) and "400" in got["bad"][1]
