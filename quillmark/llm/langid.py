"""Language identification: a linear-chain conditional random field over the words of a text.

Each word has its character n-grams with boundary marks (so prefixes and suffixes of up to four characters are
among them) and itself as a lexicon entry; labels are languages, with learned transitions. Forward-backward gives
every word of a code-switched text a distribution over languages; a document takes the language that holds most of it.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import crc_fold, map_batches, mix64

#: The field is fitted on about this many documents of each language, and so many words of each.
SAMPLE_PER_LANGUAGE, SAMPLE_WORDS = 300, 240
GRAMS, BUCKETS = 4, 1 << 16
SEGMENT, ROUNDS = 48, 60
CACHE_WORDS = 400_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words, and where each word's features start and end among them.

    Position by position of ``^word$``: the n-grams that start there (n up to GRAMS); the last place of a word holds
    the word as a whole. Bucket 0 is nothing.
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters of the word from here on
    grid = np.zeros((len(chars), GRAMS + 1), np.int64)
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h * np.uint64(0x100000001B3)
        h[: len(h) - n + 1] += chars[n - 1 :]
        grid[:, n - 1] = np.where(left >= n, (mix64(h + np.uint64(n << 56)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, 0)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix64(chars + (left.astype(np.uint64) << np.uint64(32))), out=total[1:])
    grid[ends - 1, GRAMS] = (mix64(total[ends] - total[ends - sizes]) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    return grid, ends


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of feature weights of each word, one column a label."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    at = 0
    while at < len(words):
        end, n = at, 0
        while end < len(words) and n < 200_000:
            n += len(words[end]) + 2
            end += 1
        grid, ends = word_features(words[at:end])
        sums = weights[grid].sum(axis=1, dtype=np.float64)
        out[at:end] = np.add.reduceat(sums, np.concatenate([[0], ends[:-1]]), axis=0)
        at = end
    return out


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(m.sum(axis=tuple(range(1, m.ndim)), keepdims=True), 1e-300)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, messages: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over several texts at once: each word's distribution over labels.

    ``scores``: words by labels, the texts one after the other; ``moves``: log transition weights. Long texts are
    cut into segments whose transfer matrices are computed side by side and then chained, so the result is that of
    one pass over the whole text and the number of steps doesn't grow with the longest one. ``messages`` takes up the
    forward messages, if given.
    """
    labels, n = scores.shape[1], len(scores)
    if not n:
        return np.zeros((0, labels))
    step, local = np.exp(moves - moves.max()), np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True))
    per = -(-lengths // SEGMENT)
    first = np.cumsum(per) - per
    text_of = np.repeat(np.arange(len(lengths)), per)
    within = np.arange(len(text_of)) - first[text_of]
    begin = (np.cumsum(lengths) - lengths)[text_of] + within * SEGMENT
    size = np.minimum(SEGMENT, lengths[text_of] - within * SEGMENT)
    place = begin[:, None] + np.arange(SEGMENT)
    valid = np.arange(SEGMENT) < size[:, None]
    e = np.where(valid[:, :, None], local[np.minimum(place, n - 1)], 1.0)
    product = np.broadcast_to(np.eye(labels), (len(text_of), labels, labels)).copy()
    for k in range(SEGMENT):
        live = valid[:, k]
        if not live.any():
            break
        product[live] = _scaled((product[live] @ step) * e[live, k, None, :])
    # chain the segments of each text: what comes in from the left and from the right
    left, right = np.full((len(text_of), labels), 1.0 / labels), np.ones((len(text_of), labels))
    for k in range(1, int(per.max())):
        at = first[per > k] + k
        left[at] = _scaled((left[at - 1, None, :] @ product[at - 1])[:, 0])
    for k in range(int(per.max()) - 2, -1, -1):
        at = first[per > k + 1] + k
        right[at] = _scaled((product[at + 1] @ right[at + 1, :, None])[:, :, 0])
    forward = np.zeros((len(text_of), SEGMENT, labels))
    now = left
    for k in range(SEGMENT):
        now = np.where(valid[:, k, None], _scaled((now @ step) * e[:, k]), now)
        forward[:, k] = now
    out = np.zeros((n, labels))
    now = right
    for k in range(SEGMENT - 1, -1, -1):
        live = valid[:, k]
        out[place[live, k]] = _scaled(forward[live, k] * now[live])
        if messages is not None:
            messages[place[live, k]] = forward[live, k]
        now = np.where(live[:, None], _scaled((now * e[:, k]) @ step.T), now)
    return out


@dataclass
class Field:
    """Labels, feature weights and log transition weights."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray


def fit(samples: list[tuple[str, str]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood, with a small ridge, from (language, text). Training texts are made code-switched.

    Words take the language of their document. Stretches of different documents are put one after the other, so
    that transitions between languages are seen.
    """
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    rng = np.random.Generator(np.random.PCG64(99))
    number = {lang: k for k, lang in enumerate(labels)}
    stretches = []
    for lang, text in samples:
        words = words_of(text)
        at = int(rng.integers(0, max(1, len(words) - SAMPLE_WORDS + 1)))
        words = words[at : at + SAMPLE_WORDS]
        while words:
            n = int(rng.integers(4, 40))
            stretches.append((number[lang], words[:n]))
            words = words[n:]
    rng.shuffle(stretches)
    types: dict[str, int] = {}
    flat = np.array([types.setdefault(w, len(types)) for _, ws in stretches for w in ws], np.int64)
    gold = np.array([y for y, ws in stretches for _ in ws], np.int64)
    lengths = np.full(-(-len(flat) // SEGMENT), SEGMENT)
    if not len(flat):
        return Field(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    lengths[-1] = len(flat) - SEGMENT * (len(lengths) - 1)
    grid, ends = word_features(list(types))
    owner = np.repeat(np.arange(len(types)), np.diff(ends, prepend=0))
    rows, cols = np.nonzero(grid)
    feature, kind = grid[rows, cols], owner[rows]
    used, feature = np.unique(feature, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    feature, kind = feature[order], kind[order]
    cuts = np.searchsorted(kind, np.arange(len(types)))
    k = len(labels)
    w, moves = np.zeros((len(used), k)), np.zeros((k, k))
    m, v, mm, vm = np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)
    messages = np.zeros((len(flat), k))
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    for t in range(1, rounds + 1):
        scores = np.add.reduceat(w[feature], cuts, axis=0)[flat]
        p = marginals(scores, lengths, moves, messages)
        expected = expected_moves(p, messages, moves, inside)
        off = -p
        off[np.arange(len(gold)), gold] += 1
        by_type = np.stack([np.bincount(flat, off[:, j], len(types)) for j in range(k)], 1)
        g = np.stack([np.bincount(feature, by_type[kind, j], len(used)) for j in range(k)], 1) - 1e-2 * w
        gm = (seen - expected) - 1e-2 * moves
        for x, grad, a, b in ((w, g, m, v), (moves, gm, mm, vm)):
            a += 0.1 * (grad - a)
            b += 0.02 * (grad**2 - b)
            x += 0.08 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.98**t)) + 1e-8)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = w
    return Field(labels, weights, moves)


def expected_moves(p: np.ndarray, messages: np.ndarray, moves: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Expected label pairs under the field. A pair's probability is that of its second label, dealt out over the first by the forward message."""
    step = np.exp(moves - moves.max())
    before, after = messages[:-1][inside[1:]], p[1:][inside[1:]]
    return (before.T @ (after / np.maximum(before @ step, 1e-300))) * step


class Labeller:
    """Labels words of texts; keeps the emission of each different word it has met."""

    def __init__(self, field: Field):
        self.field = field
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.used = np.zeros((1 << 14, len(self.field.labels)), np.float32), 0

    def _scores(self, words: list[str]) -> np.ndarray:
        fresh = list(set(words).difference(self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self._clear()
            fresh = list(set(words))
        if fresh:
            while self.used + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(fresh)] = emissions(fresh, self.field.weights)
            self.known.update(zip(fresh, range(self.used, self.used + len(fresh))))
            self.used += len(fresh)
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its likeliest language and that one's probability."""
        words = words_of(text)
        if not words or not self.field.labels:
            return [(w, UNKNOWN, 0.0) for w in words]
        p = marginals(self._scores(words), np.array([len(words)]), self.field.moves)
        best = p.argmax(axis=1)
        return [(w, self.field.labels[b], float(p[k, b])) for k, (w, b) in enumerate(zip(words, best))]

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language that holds most of each text, and its share of the words' probability."""
        names, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.field.labels:
            return names, share
        at = 0
        while at < len(texts):  # stretches of texts with a bounded number of words, or one text
            words: list[str] = []
            which, lengths = [], []
            while at < len(texts) and len(words) < 60_000:
                own = words_of(texts[at]) if texts[at] else []
                if own and any(map(str.isalpha, own)):
                    which.append(at)
                    lengths.append(len(own))
                    words += own
                at += 1
            if not words:
                continue
            p = marginals(self._scores(words), np.array(lengths), self.field.moves)
            held = np.add.reduceat(p, np.cumsum(lengths) - np.array(lengths), axis=0) / np.array(lengths)[:, None]
            best = held.argmax(axis=1)
            for k, i in enumerate(which):
                names[i], share[i] = self.field.labels[best[k]], min(1.0, held[k, best[k]])
        return names, share


_LABELLERS: dict[str, Labeller] = {}


def _labeller(key: str, held) -> Labeller:
    """One for each Python worker and field: the words it has met outlast the task."""
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(held.value)
    return _LABELLERS[key]


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Field:
    """Fit on about ``per_language`` documents of each language whose crc32(doc_id as text) mod 4 is not 2.

    Documents are drawn by a hash of their id, at a rate that follows from each language's count.
    """
    may = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    may = may.where("lang is not null and text is not null and doc_id is not null").where(crc_fold("doc_id", 4) != 2)
    rates = {r["lang"]: min(1.0, per_language / r["n"]) for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return fit([])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    limit = F.create_map(*(x for lang, r in rates.items() for x in (F.lit(lang), F.lit(r))))[F.col("lang")]
    got = may.where(drawn < limit).select("doc_id", "lang", "text").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit([(r["lang"], r["text"]) for r in got])


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, lang_pred, score``, one row per input row.

    Every word of the whole text is labelled; the document takes the language with the largest share. Null texts
    and texts without a letter are ``und`` with score 0. A null doc_id is not held out; ties go to the language
    that sorts first; repeated rows give equal rows; other columns are ignored; no rows give no rows.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(field), uuid.uuid4().hex  # BUCKETS by languages: bounded

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, share = _labeller(key, held).documents(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, held_out boolean, lang_pred string, score double")
