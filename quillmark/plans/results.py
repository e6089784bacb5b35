"""Bounded results on the driver: the hits of one question, and what an evaluation found."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import retrieve


@dataclass
class Result:
    """The hits of one question in rank order: at most k rows, so they fit the driver."""

    question: str
    hits: list[dict] = field(default_factory=list)
    ms: float = 0.0

    @classmethod
    def of(cls, question: str, found: DataFrame) -> Result:
        began = perf_counter()
        rows = [r.asDict(recursive=True) for r in found.orderBy("rank").collect()]
        return cls(question, rows, round(1000 * (perf_counter() - began), 2))

    @property
    def top(self) -> dict | None:
        return self.hits[0] if self.hits else None

    def context(self, max_words: int = 600) -> str:
        """The hits as numbered blocks within a budget of words."""
        blocks, left = [], max_words
        for n, h in enumerate(self.hits, 1):
            words = h["text"].split()
            if left <= 0:
                break
            body = h["text"] if len(words) <= left else " ".join(words[:left]) + " …"
            blocks.append(f"[{n}] ({h['doc']}, score {h['cos'] or 0:.2f})\n{body}")
            left -= len(words)
        return "\n\n".join(blocks)

    def to_dict(self) -> dict:
        short = lambda v: round(v, 4) if isinstance(v, float) else v
        return {"question": self.question, "ms": self.ms, "hits": [{k: short(v) for k, v in h.items() if k != "embedding"} for h in self.hits]}

    def __iter__(self) -> Iterator[dict]:
        return iter(self.hits)

    def __len__(self) -> int:
        return len(self.hits)

    def __bool__(self) -> bool:
        return bool(self.hits)

    def __repr__(self) -> str:
        lines = [f"{n:>2} {h['fused'] or 0:7.4f} {h['id']:<30.30} {h['text'][:60]!r}" for n, h in enumerate(self.hits, 1)]
        return "\n".join([f"{len(self.hits)} hits for {self.question!r} in {self.ms} ms", *lines])


@dataclass
class Report:
    """Shares of the cases that were found first, found at all, and the mean reciprocal rank."""

    n: int
    hit1: float
    hitk: float
    mrr: float
    label: str = ""

    def to_dict(self) -> dict:
        return {"label": self.label, "n": self.n, "hit1": round(self.hit1, 3), "hitk": round(self.hitk, 3), "mrr": round(self.mrr, 3)}


def evaluate(target, cases: list[tuple[str, str]], k: int = 5, label: str = "", **how) -> Report:
    """``target`` is anything with ``questions(texts)`` and ``ask(questions, k)``; a case is a question and what is expected.

    All cases are asked in one plan. A hit counts if its text holds the expectation, or its document or id is that.
    """
    asked = target.questions([q for q, _ in cases])
    expected = asked.sparkSession.createDataFrame([(n, e) for n, (q, e) in enumerate(cases) if q and q.strip()], "query_id long, expect string")
    row = retrieve.evaluate(target.ask(asked, k, **how), expected, k).select("n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("hit1", "hitk", "mrr"))).first()
    return Report(row["n"], row["hit1"], row["hitk"], row["mrr"], label)
