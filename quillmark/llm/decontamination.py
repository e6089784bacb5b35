"""Benchmark decontamination by spaced-seed hashing.

The seeds of all items are a table. One pass over the corpus lets out the seeds of each text that a filter of fixed
size may hold; these are joined with the table, which leaves pairs of a row and an item. Their texts are then
brought together, and overlaps around the hits are extended and measured.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, map_batches, mix64, row_hash, row_key, texts_of, word_hashes

#: Five chosen tokens each; the gaps are the positions that a substitution may take.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 8), (0, 1, 4, 6, 9), (0, 3, 4, 5, 9), (0, 2, 5, 6, 7))
#: A document is contaminated by an item if this share of the item's tokens is found in it, in place.
COVERAGE = 0.5
#: An extension ends when its score (1 a match, -2 a substitution) falls this far below its best.
DROP = 6
LEAST_SEGMENT = 5
#: Seeds of the corpus are sifted by two bitmaps of so many bits, whatever the benchmark's size.
COARSE_BITS, FINE_BITS = 22, 26
#: Items that are held against a text at a time.
CHUNK = 64
#: Marks the first word of an item that is shorter than a mask.
_SHORT = np.uint64(0xA24BAED4963EE407)

_PUNCTUATION = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_RNG = np.random.Generator(np.random.PCG64(5150))
_COEF = _RNG.integers(0, 2**63, (len(MASKS), 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, without ASCII punctuation and capitals."""
    return word_hashes(text.lower().translate(_PUNCTUATION))


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The seed hash at every position where the mask fits."""
    picks = MASKS[mask]
    n = len(words) - picks[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[picks[0] : picks[0] + n] * _COEF[mask, 0]
    for k in range(1, len(picks)):
        total = total + words[picks[k] : picks[k] + n] * _COEF[mask, k]
    return mix64(total)


def item_seeds(words: np.ndarray) -> np.ndarray:
    """All seeds of an item. One that is shorter than a mask is found by its first word."""
    if 0 < len(words) < len(MASKS[0]):
        return mix64(words[:1] ^ _SHORT)
    return np.concatenate([seeds(words, m) for m in range(len(MASKS))])


class Items:
    """Some items, indexed by seed."""

    def __init__(self, texts: list[bytes]):
        self.words = [tokens(text) for text in texts]
        self.short: dict[int, list[int]] = defaultdict(list)
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for k, w in enumerate(self.words):
            if 0 < len(w) < len(MASKS[0]):
                self.short[int(w[0])].append(k)
            for m in range(len(MASKS)):
                s = seeds(w, m)
                hashes.append(s)
                places.append(np.stack([np.full(len(s), k), np.arange(len(s))], 1))
        at = np.concatenate(hashes)
        order = np.argsort(at, kind="stable")
        self.hashes, self.places = at[order], np.concatenate(places)[order]

    def search(self, words: np.ndarray) -> list[tuple[int, float]]:
        """Items that contaminate the text of these words, and how much of each is in it."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for m in range(len(MASKS) if len(self.hashes) else 0):
            s = seeds(words, m)
            lo, hi = np.searchsorted(self.hashes, s), np.searchsorted(self.hashes, s, side="right")
            near = np.flatnonzero(hi > lo)
            for p, a, b in zip(near.tolist(), lo[near].tolist(), hi[near].tolist()):
                for item, q in self.places[a:b].tolist():
                    diagonals[item].add(p - q)
        found = [(item, c) for item, ds in diagonals.items() if (c := self._coverage(words, item, sorted(ds))) >= COVERAGE]
        for first in (set(words.tolist()) & self.short.keys()) if self.short else ():
            for item in self.short[first]:
                w = self.words[item]
                if any(np.array_equal(words[p : p + len(w)], w) for p in np.flatnonzero(words == w[0])):
                    found.append((item, 1.0))
        return sorted(found)

    def _coverage(self, words: np.ndarray, item: int, diagonals: list[int]) -> float:
        """The largest share of the item's tokens in place within one stretch of the text.

        Segments on nearby diagonals count together, so a word left out or put in doesn't hide a passage. The
        window slides over the sorted diagonals: each segment is added once and taken away once.
        """
        own = self.words[item]
        held = [(d, s) for d in diagonals if len(s := self._segments(words, own, d))]
        times = np.zeros(len(own), np.int64)
        covered = best = first = 0
        for d, s in held:
            while d - held[first][0] > max(2, len(own) // 4):
                gone = held[first][1]
                times[gone] -= 1
                covered -= int(np.count_nonzero(times[gone] == 0))
                first += 1
            covered += int(np.count_nonzero(times[s] == 0))
            times[s] += 1
            best = max(best, covered)
        return best / len(own)

    @staticmethod
    def _segments(words: np.ndarray, own: np.ndarray, d: int) -> np.ndarray:
        """Matching item positions on a diagonal, in segments that end where substitutions outweigh matches."""
        lo, hi = max(0, -d), min(len(own), len(words) - d)
        same = words[lo + d : hi + d] == own[lo:hi]
        kept: list[np.ndarray] = []
        at = 0
        hits = np.flatnonzero(same)
        while at < len(hits):
            score = best = 1
            end = at
            for k in range(at + 1, len(hits)):
                score += 1 - 2 * int(hits[k] - hits[k - 1] - 1)
                if score < best - DROP or score < 0:
                    break
                if score > best:
                    best, end = score, k
            if end - at + 1 >= LEAST_SEGMENT:
                kept.append(hits[at : end + 1] + lo)
            at = end + 1
        return np.concatenate(kept) if kept else np.zeros(0, int)


def _items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``item, item_id, text, seeds``, one row per item that can be found."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [item_seeds(tokens(t)).view(np.int64) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], ["item", "item_id", "text", "seeds"])

    return scratch.write(map_batches(rows.where("text is not null and item_id is not null"), run, "item long, item_id string, text string, seeds array<long>"), "items")


def _bits(seeds: DataFrame, width: int, shift: int) -> bytes:
    """A bitmap of 2 ** width bits of the seeds, from their bits above ``shift``."""
    bit = F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit((1 << width) - 1)) + 1  # bucket numbers begin with bit 1
    parts = seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = bytearray(1 << width - 3)  # as long as the parts together: 4 KiB for every 32768 bits
    for r in parts:
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    return bytes(out)


def _hits(docs: DataFrame, seeds_: DataFrame) -> DataFrame:
    """``doc_id, row_hash, seed``: the seeds of the texts that are seeds of an item (and a few others)."""
    held = docs.sparkSession.sparkContext.broadcast((_bits(seeds_, COARSE_BITS, 40), _bits(seeds_, FINE_BITS, 8)))

    def run(batch: pa.RecordBatch, memo={}) -> pa.RecordBatch:  # noqa: B006
        if "coarse" not in memo:
            memo["coarse"] = np.unpackbits(np.frombuffer(held.value[0], np.uint8), bitorder="little").view(bool)
        coarse, fine = memo["coarse"], np.frombuffer(held.value[1], np.uint8)
        owners, found = [], []
        for k, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            words = tokens(text)
            mine = []
            for m in range(len(MASKS) + 1):
                s = seeds(words, m) if m < len(MASKS) else mix64(words ^ _SHORT)
                s = s[coarse[(s >> np.uint64(40)) & np.uint64((1 << COARSE_BITS) - 1)]]
                at = (s >> np.uint64(8)) & np.uint64((1 << FINE_BITS) - 1)
                mine.append(s[(fine[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0])
            mine = np.unique(np.concatenate(mine))
            found.append(mine)
            owners.append(np.full(len(mine), k))
        which = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
        seed = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(seed)], ["doc_id", "row_hash", "seed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.where("text is not null"), run, "doc_id long, row_hash long, seed long")


def overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, row_hash, item_id, overlap``: the items that are found in a row, and how much of each."""
    items = _items(benchmark, scratch)
    seeds_ = scratch.write(items.select("item", F.explode("seeds").alias("seed")).distinct(), "seeds")
    pairs = scratch.write(_hits(docs, seeds_).join(seeds_, "seed").select("doc_id", "row_hash", "item").distinct(), "pairs")
    # a row's items come in chunks, however many they are
    count = pairs.groupBy("row_hash").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.select("row_hash", "item").distinct().join(count, "row_hash").withColumn("chunk", F.pmod(F.xxhash64("item"), "chunks"))
    listed = dealt.join(items.select("item", "item_id", "text"), "item").groupBy("row_hash", "chunk").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    both = texts_of(docs, pairs).distinct().join(listed, "row_hash").select("doc_id", "row_hash", "text", "items")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, row, text, items in zip(*(c.to_pylist() for c in batch.columns)):
            index = Items([i["text"].encode() for i in items])
            rows += ((doc_id, row, items[k]["item_id"], share) for k, share in index.search(tokens(text.encode())))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "row_hash", "item_id", "overlap"])

    return map_batches(both, run, "doc_id long, row_hash long, item_id string, overlap double")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without contaminated rows. Only the keys of these are joined with ``docs``."""
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.write(overlaps(docs, benchmark, scratch).select("doc_id", "row_hash").distinct(), "leaks", keep=True)
    names, own, other = row_key(found)
    return docs.withColumns(own).join(other, names, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``doc_id, contaminated, kept, n_items, items, best_overlap``.

    One row per input row, judged by its own text, whatever its id. A document is contaminated if half of an item's
    tokens or more are found in it in place, in segments of five tokens or more that tolerate substitutions, on
    neighbouring diagonals. Items of fewer than five tokens count only as a whole. Null and empty texts are clean,
    null and empty items match nothing, repeated rows give equal rows; an empty benchmark leaves all clean; other
    columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = overlaps(docs, benchmark, scratch).groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("overlap").alias("best_overlap"))
        found = scratch.write(found, "overlaps", keep=True)
    names, own, other = row_key(found, "items", "best_overlap")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(own).drop("text").join(other, names, "left")
    bad = F.col("items").isNotNull()
    count = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    return rows.select("doc_id", bad.alias("contaminated"), (~bad).alias("kept"), F.when(bad, count).otherwise(F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"), F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap"))
