"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import crc_fold, filter_texts, map_batches

#: The classifier is fitted on at most this many labelled rows of each class (those with the smallest id hashes).
SAMPLE_PER_CLASS = 3000
#: A lexicon entry is seen in so many different training texts at least, and has so many letters as a word prefix.
LEAST_SEEN, PREFIXES = 3, (4, 5, 6, 7, 8)
#: It is so many times as frequent in toxic training texts as in others.
LEAST_RATIO = 10
THRESHOLD = 0.7

_LOOKS_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ԛ": "q", "ԝ": "w", "ɡ": "g", "һ": "h",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ｌ": "l", "ӏ": "i",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l",
}
_NOTHING = "­​‌‍⁠﻿️"


def _fold_table() -> dict[int, str | None]:
    """Lower-cased characters to folded ones: look-alikes to Latin letters, i and l to one letter, the rest to blanks."""
    table: dict[int, str | None] = {c: " " for c in range(0x80) if not chr(c).isalnum()}
    table |= {c: " " for c in (*range(0x80, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004)) if chr(c) not in "ªºµ"}
    table |= {ord(k): v for k, v in _LOOKS_LIKE.items()}
    table |= {c: None for c in (*map(ord, _NOTHING), *range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x20D0, 0x2100))}  # marks put on letters
    return {c: "i" if v == "l" else v for c, v in table.items()} | {ord("l"): "i"}


_FOLD = _fold_table()


def fold(text: str) -> str:
    """The text as the lexicon sees it: words between single or repeated blanks, one blank at either end.

    Letters in other dress (mathematical, full-width, circled) become plain ones and lose their accents.
    """
    plain = text if text.isascii() else unicodedata.normalize("NFKD", text)
    return " " + plain.lower().translate(_FOLD) + " "


@dataclass
class Model:
    """Weighted patterns (" word " or " prefix"), phrases that excuse a match inside them, and the final line."""

    lexicon: dict[str, float] = field(default_factory=dict)
    excused: list[str] = field(default_factory=list)
    line: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.lexicon.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.excused:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found


def weigh(automaton, folded: str) -> float:
    """Sum of the weights of all matches but those inside an excused phrase."""
    if not len(automaton):
        return 0.0
    hits, free = [], []
    for end, (size, weight) in automaton.iter(folded):
        (hits if weight else free).append((end - size + 1, end, weight))
    if free:
        hits = [h for h in hits if not any(a <= h[0] and h[1] - 1 <= b for a, b, _ in free)]
    return sum(h[2] for h in hits)


def _shape(total: float, n_chars: int) -> tuple[float, float]:
    """What the final line sees: the weight found, damped, and the weight by length (a thousand characters)."""
    return math.log1p(total), math.log1p(1000 * total / (n_chars + 200))


def _patterns(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _families(text: str) -> list[int]:
    """Three independent least hashes of any three words in a row: near copies of a text share one or more."""
    words = text.split()
    grams = {xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))}
    return [min(grams, key=lambda h: h * odd & 0xFFFFFFFFFFFFFFFF) * 4 + k & 0xFFFFFFFFFFFFFFFF for k, odd in enumerate((1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))]


def _surprise(a: int, n: int, b: int, m: int) -> float:
    """Twice the log likelihood ratio of a in n against b in m."""
    total = 0.0
    for x, size, y, rest in ((a, n, b, m), (b, m, a, n)):
        p, q = x / size, (x + y) / (size + rest)
        total += (x * math.log(p / q) if x else 0) + ((size - x) * math.log((1 - p) / (1 - q)) if x < size else 0)
    return 2 * total


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Learn lexicon, excused phrases and final line from labelled texts. Near copies of a text count once."""
    seen: dict[int, set[int]] = defaultdict(set)
    counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    folded = [fold(t) for t in texts]
    first = []
    for text, y in zip(folded, toxic):
        keys = _families(text)
        if seen[y].isdisjoint(keys):
            first.append((text, y))
        seen[y].update(keys)
    size = {y: max(1, sum(label == y for _, label in first)) for y in (0, 1)}
    for text, y in first:
        if y:
            counts[1].update(_patterns(text))
    likely = {p for p, k in counts[1].items() if k >= LEAST_SEEN}
    for text, y in first:
        if not y:
            counts[0].update(_patterns(text) & likely)
    need = 2 * math.log(max(2, len(likely))) + 4
    ranked = []
    for p in likely:
        a, b = counts[1][p], counts[0][p]
        if a / size[1] > LEAST_RATIO * b / size[0] and (g := _surprise(a, size[1], b, size[0])) >= need:
            ranked.append((g, p, math.log((a + 0.5) / (size[1] + 1)) - math.log((b + 0.5) / (size[0] + 1))))
    model, held = Model(), set()
    for _, p, weight in sorted(ranked, key=lambda r: (-r[0], len(r[1]), r[1])):
        stem = p.strip()
        if any(stem[:n] in held for n in range(1, len(stem) + 1)):
            continue  # a prefix or the word itself is in already
        held.add(stem)
        model.lexicon[p] = round(weight, 4)
    model.excused = _excuses(model, first)
    automaton = model.automaton()
    xs = np.array([(1, *_shape(weigh(automaton, t), len(t))) for t, _ in first], float).reshape(-1, 3)
    ys = np.array([y for _, y in first], float)
    model.line = _line(xs, ys)
    return model


def _excuses(model: Model, texts: list[tuple[str, int]]) -> list[str]:
    """Phrases of a match and a neighbouring word that harmless texts use again and again and toxic ones never do."""
    phrases: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    automaton = model.automaton()
    if not len(automaton):
        return []
    for text, y in texts:
        found = set()
        for end, (size, _) in automaton.iter(text):
            start = end - size + 2
            stop = text.find(" ", start)
            before, after = text[:start].split()[-1:] if start < 200 else text[start - 60 : start].split()[-1:], text[stop : stop + 60].split()[:1]
            word = text[start:stop]
            found |= {f" {before[0]} {word} "} if before else set()
            found |= {f" {word} {after[0]} "} if after else set()
        phrases[y].update(found)
    return sorted(p for p, k in phrases[0].items() if k >= LEAST_SEEN and not phrases[1][p])


def _line(xs: np.ndarray, ys: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; classes weigh alike."""
    w = np.zeros(3)
    if not len(ys) or ys.min() == ys.max():
        return (-3.0, 1.0, 1.0)
    weight = np.where(ys > 0, 0.5 / ys.mean(), 0.5 / (1 - ys.mean())) / len(ys)
    ridge = np.diag([1e-4, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        step = np.linalg.solve((xs * (weight * p * (1 - p))[:, None]).T @ xs + ridge, xs.T @ (weight * (ys - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return tuple(float(x) for x in w)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class whose crc32(doc_id as text) mod 3 is not 1."""
    may = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    may = may.where((crc_fold("doc_id", 3) != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [may.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()  # at most 2 * per_class texts
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in got], [r["toxic"] for r in got])


def scorer(model: Model) -> Callable[[list], np.ndarray]:
    """A function from texts to scores; each worker builds the automaton once."""

    def score_of(texts: list, memo={}) -> np.ndarray:  # noqa: B006
        if "automaton" not in memo:
            memo["automaton"] = model.automaton()
        automaton, (c, a, b) = memo["automaton"], model.line
        scores = np.zeros(len(texts))
        for k, text in enumerate(texts):
            folded = fold(text or "")
            x, y = _shape(weigh(automaton, folded), len(folded))
            scores[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y))))
        return scores

    return score_of


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without rows that score ``threshold`` or more. Null texts stay."""
    score_of = scorer(model)
    return filter_texts(docs, lambda texts: score_of(texts) < threshold)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, score, predicted``, one row per input row.

    The whole text is folded and matched; the score is the logistic of the weight found and of the weight by
    length. Null and empty texts match nothing and get the score of no match; a null doc_id is not held out.
    Repeated rows get equal scores, other columns are ignored, an empty table gives no rows.
    """

    score_of = scorer(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = score_of(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, held_out boolean, score double, predicted int")
