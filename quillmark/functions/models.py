"""Connectors for models: embedders, rerankers and chat behind Arrow-batched functions, with offline stand-ins."""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import overlap_score
from quillmark.functions.vector import hashed_embedding

#: Dimensions of some public models, so that they needn't be given.
SIZES = {"all-minilm": 384, "nomic-embed-text": 768, "mxbai-embed-large": 1024}
SERVER = "http://localhost:11434"


class ModelError(RuntimeError):
    """A model's reply doesn't fit the request."""


@dataclass(frozen=True)
class Embedder:
    """A name, a dimension and a column function from texts to unit vectors."""

    name: str
    dim: int
    apply: Callable[[Column], Column]


def hashed(dim: int = 384) -> Embedder:
    """The deterministic stand-in: equal texts have cosine 1, different ones about 0. Built-in functions only."""
    if not 1 <= dim <= 8192:
        raise ValueError("the dimension must be from 1 to 8192")
    return Embedder(f"hashed:{dim}", dim, lambda text: hashed_embedding(text, dim))


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def checked(vectors: list, count: int, dim: int) -> list[list[float]]:
    if len(vectors) != count:
        raise ModelError(f"{count} texts gave {len(vectors)} vectors")
    if any(not isinstance(v, list) or len(v) != dim for v in vectors):
        raise ModelError(f"a vector is not of dimension {dim}")
    return vectors


def _unit(v: list[float]) -> list[float]:
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v] if length else v


def http(model: str, dim: int | None = None, url: str = SERVER, timeout: float = 90.0, batch: int = 16, post=_post) -> Embedder:
    """An embedding server; texts go in requests of ``batch``. Replies are checked for number and dimension."""
    size = dim or SIZES[model]

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch].tolist()
                reply = post(f"{url}/api/embed", {"model": model, "input": some}, timeout)
                out += checked(reply.get("embeddings") or [reply.get("embedding")], len(some), size)
            yield pd.Series([_unit(v) for v in out])

    return Embedder(f"{model}", size, lambda text: embed(text))


def embedder(spec: str) -> Embedder:
    """``hashed``, ``hashed:64`` or ``http:model``."""
    name, rest = (spec.split(":", 1) + [""])[:2]
    made = {"hashed": lambda: hashed(int(rest or 384)), "http": lambda: http(rest or "nomic-embed-text")}
    if name not in made:
        raise ValueError(f"{spec!r} names no embedder; there are {', '.join(made)}")
    return made[name]()


Reranker = Callable[[Column, Column], Column]


def reranker(spec: str | Reranker | None, score: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> Reranker | None:
    """``overlap``, ``model`` (with a scoring function, called in batches of 32) or a column function of query and text."""
    if spec is None or callable(spec):
        return spec
    if spec == "overlap":
        return overlap_score
    if spec == "model" and score:

        @F.pandas_udf("double")
        def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, texts in parts:
                pairs = list(zip(queries, texts))
                yield pd.Series([s for at in range(0, len(pairs), 32) for s in score(pairs[at : at + 32])], dtype="float64")

        return lambda q, t: scored(q, t)
    raise ValueError(f"unknown reranker {spec!r}")


def chat(reply: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function from prompts to replies; ``reply`` runs in the executors' workers."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield prompts.map(reply)

    return lambda prompt: run(prompt)


def cross_encoder(load: Callable[[], object], most_chars: int = 2000, batch: int = 32) -> Reranker:
    """A cross-encoder as a reranker. ``load`` gives a model with ``predict(pairs)``; each worker calls it once and keeps the model."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        key = f"{load.__module__}.{load.__qualname__}"
        if key not in _LOADED:
            _LOADED[key] = load()
        for queries, texts in parts:
            pairs = [(q, (t or "")[:most_chars]) for q, t in zip(queries, texts)]
            scores = [float(x) for at in range(0, len(pairs), batch) for x in _LOADED[key].predict(pairs[at : at + batch])]
            if len(scores) != len(pairs):
                raise ModelError(f"{len(pairs)} pairs gave {len(scores)} scores")
            yield pd.Series(scores, dtype="float64")

    return lambda q, t: scored(q, t)


_LOADED: dict[str, object] = {}


def _lines(url: str, body: dict, timeout: float) -> Iterator[dict]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        for line in reply:
            if line.strip():
                yield json.loads(line)


@dataclass(frozen=True)
class ChatServer:
    """A chat model behind HTTP, at temperature 0. ``reply`` gives the whole answer, ``tokens`` piece by piece."""

    model: str
    url: str = SERVER
    timeout: float = 600.0
    system: str | None = None
    post: Callable[[str, dict, float], dict] = _post
    lines: Callable[[str, dict, float], Iterator[dict]] = _lines

    def _body(self, prompt: str, stream: bool, **options) -> dict:
        said = [{"role": "system", "content": self.system}] if self.system else []
        return {"model": self.model, "messages": [*said, {"role": "user", "content": prompt}], "stream": stream, "options": {"temperature": 0, **options}}

    def reply(self, prompt: str, **options) -> str:
        found = self.post(f"{self.url}/api/chat", self._body(prompt, False, **options), self.timeout)
        if not isinstance(text := (found.get("message") or {}).get("content"), str):
            raise ModelError(f"{self.model} gave no answer")
        return text

    def tokens(self, prompt: str, **options) -> Iterator[str]:
        """The answer as it comes; it runs on the driver, for one prompt."""
        for part in self.lines(f"{self.url}/api/chat", self._body(prompt, True, **options), self.timeout):
            if text := (part.get("message") or {}).get("content"):
                yield text
            if part.get("done"):
                return

    def column(self) -> Callable[[Column], Column]:
        """A column function from prompts to replies, for many prompts at once."""
        return chat(self.reply)
