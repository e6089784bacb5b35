"""What a running engine can tell of itself: counters, recent errors and slow calls, latencies, recall."""

from __future__ import annotations

import time
from collections import Counter, deque
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT, SLOW_MS, SHOWN = 50, 100.0, 10


@dataclass
class Observed:
    """Counters of one object, the last errors of each kind and the last slow calls; memory is bounded by ``KEPT``."""

    counters: Counter = field(default_factory=Counter)
    errors: dict[str, deque] = field(default_factory=dict)
    slow: deque = field(default_factory=lambda: deque(maxlen=KEPT))
    started: float = field(default_factory=time.time)

    def error(self, kind: str, what: str, problem: BaseException) -> None:
        self.errors.setdefault(kind, deque(maxlen=KEPT)).append({"ts": time.time(), "what": what, "problem": (str(problem) or type(problem).__name__)[:200]})

    def took(self, what: str, ms: float) -> None:
        if ms >= SLOW_MS:
            self.slow.append({"ts": time.time(), "what": what, "ms": round(ms, 2)})

    @contextmanager
    def call(self, what: str, kind: str = "call"):
        """Count a call, note it if it is slow, and its error if it fails."""
        began = time.perf_counter()
        self.counters[what] += 1
        try:
            yield
        except Exception as e:
            self.error(kind, what, e)
            raise
        finally:
            self.took(what, 1000 * (time.perf_counter() - began))

    def within(self, kind: str, seconds: float) -> list[dict]:
        """Errors of the last so many seconds."""
        return [e for e in self.errors.get(kind, ()) if e["ts"] >= time.time() - seconds]

    def stats(self) -> dict:
        recent = {f"{kind}_errors_{name}": len(self.within(kind, s)) for kind in sorted({"embed", "chat", *self.errors}) for name, s in (("1h", 3600), ("24h", 86400))}
        return {"counters": dict(self.counters), **recent, "slow": list(self.slow)[-SHOWN:], "uptime_seconds": int(time.time() - self.started)}


def counted_within(events: DataFrame, seconds: float, now: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``n`` of ``events(ts)`` in the window of so many seconds that ends ``now``."""
    return events.where((F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now)).groupBy(*by).agg(F.count("*").alias("n"))


def age_seconds(then: Column, now: Column | None = None) -> Column:
    """Seconds since a moment given in epoch seconds."""
    return (F.unix_micros(F.current_timestamp()) / 1_000_000 if now is None else now) - then


def latencies(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``n, p50, p95`` of ``calls(ms)``, interpolated, at two places."""
    at = lambda p: F.round(F.percentile("ms", p), 2)
    return calls.groupBy(*by).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``query_id, recall``: the share of each query's k true rows that were found among its first k."""
    cut = lambda rows: rows.where(F.col("rank") <= k).select("query_id", "id").distinct()
    hit = cut(truth).join(cut(found).withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
