"""Models as plain objects: chat (`invoke(prompt) -> str`) and embedders (`embed(text) -> list of float`).

Any object with these methods works if it can be pickled; adapters to providers are left to the caller. Those here are
deterministic and local, for tests and for runs without a model.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Chat(Protocol):
    def invoke(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


class FakeChat:
    """Answers with the first digits of the prompt's hash; a map request (`helpfulness` is in it) as JSON."""

    def invoke(self, prompt: str) -> str:
        h = hashlib.sha256(prompt.encode("utf-8", "surrogatepass")).hexdigest()
        if "helpfulness" in prompt:
            return json.dumps({"answer": f"answer {h[:8]}", "helpfulness": int(h[:2], 16) % 101})
        return f"answer {h[:8]}"


class Scripted:
    """Answers by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def invoke(self, prompt: str) -> str:
        return self.answer(prompt)


class Provider:
    """A chat or embedder that is built by a function on the worker that first needs it, so that clients aren't pickled."""

    def __init__(self, make: Callable[[], object]):
        self.make, self._own = make, None

    def __getstate__(self) -> dict:
        return {"make": self.make, "_own": None}

    def _get(self):
        if self._own is None:
            self._own = self.make()
        return self._own

    def invoke(self, prompt: str) -> str:
        return self._get().invoke(prompt)

    def embed(self, text: str) -> list[float]:
        return self._get().embed(text)


class HashEmbedder:
    """Words hashed into dims signed sums, brought to length 1."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dims)
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % self.dims] += 1 if h[4] & 1 else -1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()


class Params:
    """An embedder with fixed parameters for each call."""

    def __init__(self, own: Embedder, **params):
        self.own, self.params = own, params

    def embed(self, text: str) -> list[float]:
        return self.own.embed(text, **self.params)


def dims(embedder: Embedder) -> int:
    return len(embedder.embed("dimension"))


def embed(df: DataFrame, text: Column, embedder: Embedder, into: str = "embedding") -> DataFrame:
    """df with the texts' vectors and `embed_error`; one pass, a text that fails has a null vector and its error."""

    @F.pandas_udf("struct<v:array<float>,e:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                try:
                    out.append((None if t is None else embedder.embed(t), None))
                except Exception as e:  # noqa: BLE001 - kept as the row's error
                    out.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["v", "e"])

    return df.withColumn("_e", run(text)).withColumns({into: F.col("_e.v"), "embed_error": F.col("_e.e")}).drop("_e")
