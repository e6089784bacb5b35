"""Packing documents into token windows: Karmarkar-Karp multiway differencing of document remainders."""

from __future__ import annotations

import functools
import heapq
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import map_batches, materialize

WINDOW, END_ID = 4096, 2
#: A document's last ``length mod WINDOW`` ids are cut into pieces of at most this many.
PIECE = 512
#: Windows that are balanced against each other: bounds one group's work, whatever the corpus.
GROUP_WINDOWS = 192
#: Different words that a worker remembers, besides those of one batch.
CACHE_WORDS = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = PIECES + ", sequence_id long, offset long"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Words numbered as they are first asked for; ``fresh`` are those whose ids are still to be learned."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordCachedTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, for tokenizers that drop white space.

    Such a tokenizer never joins what white space divides, and this one takes a run of letters for itself and ignores
    capitals. So a text's ids are those of its words one after the other, and each different run of letters goes
    through the tokenizer once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.latin = Tokenizer(self.tokenizer.model)  # for runs of letters that need no rules to find and no change
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), self.tokenizer.pre_tokenizer[1]])
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)

    def _put(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.known) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def _ask(self, words: list[str], numbers: list[int]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._put(numbers, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def _ask_letters(self, words: list[str], numbers: list[int], tokenizer) -> None:
        """Runs of letters, many at once: the last id of each is one that ends a word."""
        for at in range(0, len(words), 128):
            some = words[at : at + 128]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                self._put(numbers[at : at + 128], ids, np.diff(last, prepend=-1))
            else:
                self._ask(some, numbers[at : at + 128])

    def _learn(self) -> None:
        """The ids of all fresh words; letters with ASCII marks behind them are put together from both parts."""
        fresh, self.known.fresh = self.known.fresh, []
        first = len(self.known) - len(fresh)
        kinds: dict[str, tuple[list[str], list[int]]] = {k: ([], []) for k in ("latin", "letters", "other")}
        marked, parts = [], []
        while fresh:
            for n, word in enumerate(fresh, first):
                stem = word.rstrip(_MARKS)
                if len(stem) < len(word) and stem.isalpha():
                    marked.append(n)
                    parts += (self.known[stem], self.known[word[len(stem) :]])  # either may be fresh itself
                    continue
                words, numbers = kinds["other" if not word.isalpha() else "latin" if word.isascii() or max(word) < "\u0250" else "letters"]
                words.append(word)
                numbers.append(n)
            first += len(fresh)
            fresh, self.known.fresh = self.known.fresh, []
        self._ask_letters(*kinds["latin"], self.latin)
        self._ask_letters(*kinds["letters"], self.tokenizer)
        if kinds["other"][0]:
            self._ask(*kinds["other"])
        if marked:
            at = np.array(parts, np.int64)
            self._put(marked, self._gather(at), self.size[at].reshape(-1, 2).sum(axis=1))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1]) + np.repeat(self.start[at] - ends + sizes, sizes)]

    def _words(self, text: str) -> list[str] | None:
        """Lower-cased words, or None where Python would divide or lower-case otherwise than the tokenizer."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if any(x in text for x in _ODD):
            return None
        return text.lower().split()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of whole texts, one after the other; new words of all texts are learned together."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        number = self.known.__getitem__
        split = [self._words(t) for t in texts]
        found = [np.fromiter(map(number, words), np.int64, len(words)) if words else words for words in split]
        if self.known.fresh:
            self._learn()
        for text, at in zip(texts, found):
            if at is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            elif not len(at):
                yield np.zeros(0, np.uint32)
            else:
                yield self._gather(at)


#: What the tokenizer never takes into a run of letters.
_MARKS = string.punctuation
#: Where Python splits or lower-cases otherwise than the tokenizer, or the tokenizer knows the string as a whole.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "<|startoftext", "<|endoftext")


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordCachedTokenizer:
    """One for each Python worker: what it knows outlasts the task."""
    return WordCachedTokenizer(path)


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids (its text's, then ``end_id``) into whole windows and a remainder in small pieces."""
    path = path or word_bpe_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(path)
        rows: list[tuple] = []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc_id, own in zip(batch.column(0).to_pylist(), tokenizer.encode(texts)):
            ids = np.append(own, np.uint32(end_id)).astype("<u4", copy=False)
            full = len(ids) - len(ids) % window
            for a in (*range(0, full, window), *range(full, len(ids), piece)):
                b = a + window if a < full else min(a + piece, len(ids))
                rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: split the items into ``ways`` sets of near-equal sums; gives the items' numbers by set.

    The heap holds partial partitions, the most uneven first. The two most uneven are merged with the largest
    sets of one on the smallest of the other. Sets that are still empty aren't stored.
    """
    heap = [(-s, k, [(s, [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - ways  # so many sets of either meet
        if over <= 0:
            both = a + b
        else:
            both = a[: len(a) - over] + b[: len(b) - over]
            both += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]))]
        both.sort(key=lambda s: -s[0])
        gap = both[0][0] - (both[-1][0] if len(both) == ways else 0)
        heapq.heappush(heap, (-gap, tie, both))
        tie += 1
    found = [s[1] for s in heap[0][2]] if heap else []
    return found + [[] for _ in range(ways - len(found))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises until none is too full."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, ways)
        if all(sum(sizes[k] for k in w) <= capacity for w in found):
            return [w for w in found if w]
        ways += 1


def pack(cut: DataFrame, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Give every piece of ``cut`` a window and a place in it; see ``pack_documents``."""
    total = cut.where(F.col("length") < window).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * group_windows)))

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = order.column("length").to_pylist()
        group = order.column("part")[0].as_py()
        whole = [k for k, n in enumerate(lengths) if n == window]
        rest = [k for k, n in enumerate(lengths) if n < window]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        sequence[whole] = np.arange(len(whole))
        for w, members in enumerate(windows_of([lengths[k] for k in rest], window)) if rest else ():
            at = 0
            for k in sorted(rest[m] for m in members):
                sequence[k], offset[k] = len(whole) + w, at
                at += lengths[k]
        return order.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of its whole text and then id 2 (null and empty texts: id 2 alone). Every whole
    window of a document is a sequence; the rest, in pieces, is dealt by a hash of the piece to groups of about
    ``GROUP_WINDOWS`` windows, and each group is balanced by differencing. All runs of it give the same packing.
    Rows that repeat a doc_id are packed one by one; a null doc_id stays null; no rows give no rows.
    """
    return pack(materialize(pieces(docs, path, window), "pieces"), window)
