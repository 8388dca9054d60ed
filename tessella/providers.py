"""Adapters to model providers over plain HTTP, so that no client library is needed.

Each is an object with invoke(prompt) -> str or embed(text) -> list of float (see tessella.models). They hold strings and
numbers only, so they can be pickled to workers; a key is read from the environment of the process that calls if none is
given. A request that meets a busy server (429, 500, 502, 503, 529) or no server is tried again, ATTEMPTS times in all.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request

ATTEMPTS, TIMEOUT = 4, 120.0
BUSY = (429, 500, 502, 503, 529)
OPENAI, OPENROUTER, ANTHROPIC, OLLAMA = "https://api.openai.com/v1", "https://openrouter.ai/api/v1", "https://api.anthropic.com", "http://localhost:11434"


class ProviderError(RuntimeError):
    """What a provider answered instead of a result."""


def post(url: str, body: dict, headers: dict[str, str], timeout: float = TIMEOUT, attempts: int = ATTEMPTS, pause: float = 1.0) -> dict:
    """The JSON object that a POST of a JSON object gives."""
    data = json.dumps(body).encode()
    for left in reversed(range(attempts)):
        request = urllib.request.Request(url, data, {"content-type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                found = json.loads(r.read())
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace")[:500]
            if e.code not in BUSY or not left:
                raise ProviderError(f"{url} answered {e.code}: {said}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            if not left:
                raise ProviderError(f"{url} can't be reached: {e}") from e
        else:
            error = found.get("error") if isinstance(found, dict) else "not an object"
            if error:
                raise ProviderError(f"{url} answered with an error: {json.dumps(error)[:500]}")
            return found
        time.sleep(pause * 2 ** (attempts - 1 - left))
    raise ProviderError(f"{url} wasn't asked")


def _part(found: dict, *path: str | int):
    """What lies at a path of an answer; an error that shows the answer if there is nothing."""
    x = found
    for p in path:
        try:
            x = x[p]
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"the answer has no {'.'.join(map(str, path))}: {json.dumps(found)[:500]}") from e
    return x


class _Client:
    key_name = ""

    def __init__(self, model: str, base_url: str, api_key: str | None = None, params: dict | None = None, timeout: float = TIMEOUT, pause: float = 1.0):
        self.model, self.base_url, self.api_key, self.params, self.timeout, self.pause = model, base_url.rstrip("/"), api_key, dict(params or {}), timeout, pause

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.model!r}, {self.base_url!r})"

    def _key(self) -> str:
        return self.api_key or os.environ.get(self.key_name, "")

    def _headers(self) -> dict[str, str]:
        return {"authorization": f"Bearer {self._key()}"} if self._key() else {}

    def _post(self, path: str, body: dict) -> dict:
        return post(self.base_url + path, body, self._headers(), self.timeout, pause=self.pause)


class OpenAIChat(_Client):
    """Chat completions of a server that speaks OpenAI's protocol."""

    key_name = "OPENAI_API_KEY"

    def __init__(self, model: str, base_url: str = OPENAI, **options):
        super().__init__(model, base_url, **options)

    def _path(self, what: str) -> str:
        return what

    def invoke(self, prompt: str, **params) -> str:
        found = self._post(self._path("/chat/completions"), {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.params, **params})
        return _part(found, "choices", 0, "message").get("content") or ""


class _Azure:
    """The deployment is in the path, the key in a header of its own."""

    key_name = "AZURE_OPENAI_API_KEY"

    def __init__(self, model: str, endpoint: str, api_version: str = "2024-06-01", **options):
        super().__init__(model, endpoint, **options)
        self.api_version = api_version

    def _headers(self) -> dict[str, str]:
        return {"api-key": self._key()}

    def _path(self, what: str) -> str:
        return f"/openai/deployments/{urllib.parse.quote(self.model, safe='')}{what}?api-version={urllib.parse.quote(self.api_version)}"


class AzureChat(_Azure, OpenAIChat):
    """OpenAI's protocol on Azure; model is the deployment's name."""


class OpenAIEmbedder(_Client):
    """Embeddings of a server that speaks OpenAI's protocol."""

    key_name = "OPENAI_API_KEY"

    def __init__(self, model: str, base_url: str = OPENAI, **options):
        super().__init__(model, base_url, **options)

    def _path(self, what: str) -> str:
        return what

    def embed(self, text: str, **params) -> list[float]:
        found = self._post(self._path("/embeddings"), {"model": self.model, "input": text, **self.params, **params})
        return [float(x) for x in _part(found, "data", 0, "embedding")]


class AzureEmbedder(_Azure, OpenAIEmbedder):
    """OpenAI's embeddings on Azure; model is the deployment's name."""


class OllamaChat(_Client):
    def __init__(self, model: str, base_url: str = OLLAMA, **options):
        super().__init__(model, base_url, **options)

    def invoke(self, prompt: str, **params) -> str:
        found = self._post("/api/chat", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False, **self.params, **params})
        return _part(found, "message").get("content") or ""


class OllamaEmbedder(_Client):
    def __init__(self, model: str, base_url: str = OLLAMA, **options):
        super().__init__(model, base_url, **options)

    def embed(self, text: str, **params) -> list[float]:
        return [float(x) for x in _part(self._post("/api/embed", {"model": self.model, "input": text, **self.params, **params}), "embeddings", 0)]


class AnthropicChat(_Client):
    """Anthropic's messages; an answer is its text blocks."""

    key_name = "ANTHROPIC_API_KEY"

    def __init__(self, model: str, base_url: str = ANTHROPIC, max_tokens: int = 4096, **options):
        super().__init__(model, base_url, **options)
        self.max_tokens = max_tokens

    def _headers(self) -> dict[str, str]:
        return {"x-api-key": self._key(), "anthropic-version": "2023-06-01"}

    def invoke(self, prompt: str, **params) -> str:
        found = self._post("/v1/messages", {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}], **self.params, **params})
        return "".join(b.get("text", "") for b in _part(found, "content") if b.get("type") == "text")


class SentenceTransformerEmbedder:
    """A model of the sentence_transformers package, loaded by the worker that first needs it."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", **options):
        self.model, self.options, self._own = model, options, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "options": self.options, "_own": None}

    def embed(self, text: str, **params) -> list[float]:
        if self._own is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ImportError("sentence_transformers isn't installed") from e
            self._own = SentenceTransformer(self.model, **self.options)
        return [float(x) for x in self._own.encode([text], **params)[0]]


def _openrouter(of: type):
    def make(model: str, base_url: str = OPENROUTER, api_key: str | None = None, **options):
        return of(model, base_url, api_key=api_key or os.environ.get("OPENROUTER_API_KEY"), **options)

    return make


CHATS = {"openai": OpenAIChat, "azure_openai": AzureChat, "ollama": OllamaChat, "openrouter": _openrouter(OpenAIChat), "anthropic": AnthropicChat}
EMBEDDERS = {"openai": OpenAIEmbedder, "azure_openai": AzureEmbedder, "ollama": OllamaEmbedder, "openrouter": _openrouter(OpenAIEmbedder), "sentence-transformer": SentenceTransformerEmbedder}


def _make(kinds: dict, what: str, provider: str, model: str, options: dict):
    if provider not in kinds:
        raise ValueError(f"{provider!r} is no {what} provider; there are {', '.join(kinds)}")
    return kinds[provider](model, **options)


def chat(provider: str, model: str, **options):
    """A chat model of a provider: openai, azure_openai, ollama, openrouter or anthropic."""
    return _make(CHATS, "chat", provider, model, options)


def embedder(provider: str, model: str, **options):
    """An embedder of a provider: openai, azure_openai, ollama, openrouter or sentence-transformer."""
    return _make(EMBEDDERS, "embedding", provider, model, options)
