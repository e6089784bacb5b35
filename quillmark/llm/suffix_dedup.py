"""Removal of repeated 100-byte strings, with suffix arrays built by linear grouping.

Equal strings are brought together by anchors: in every window of ``length`` bytes the k-gram with the smallest hash.
Equal windows have equal anchors at equal places, so windows only need to be compared within an anchor's group. The
windows that an anchor's occurrence serves are one context. Of occurrences whose whole context is the same (by the
64-bit hashes of the anchor and of the context) the first stands for all. Where an anchor has several different
contexts, their suffixes are sorted. An anchor with very many of them is made longer first, on either side, until few
different contexts share it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import _BYTE, _INV, _POW, Scratch, map_batches, mix64, row_hash, small_batches, texts_of

LENGTH, GRAM = 100, 32
#: An anchor with more different contexts than this isn't sorted in one task.
GROUP = 512
_BLOCK = 1 << 17
_PLACE = np.uint64((1 << 18) - 1)


def linear_grouping_suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array, in linear time and without renaming or recursion.

    Suffixes start in groups by their first symbol. Phase 1 takes the groups in descending order. Each suffix of a
    group gets its previous-smaller pointer, the nearest earlier suffix of a lower group; suffixes that are pointed
    to leave their group for a new one right above it, by the number of pointers, the most pointed to highest. In
    the end a group holds the suffixes with one Lyndon prefix. Phase 2 fills the groups in ascending order: when a
    suffix is emitted, those whose Lyndon prefix ends in front of it take their groups' next places.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, s in enumerate(order):
        if k and text[order[k - 1]] != text[s]:
            start = k
        place[s], group[s] = k, start
        size[start] += 1
    prev = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        members = sorted(order[start:end])
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            levels: dict[int, list[int]] = {}
            for p, c in count.items():
                levels.setdefault(c, []).append(p)
            for c in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for p in levels[c]:  # to the tail of its group
                    g = group[p]
                    m = moved.get(g, 0)
                    last = g + size[g] - 1 - m
                    q, at = order[last], place[p]
                    order[last], order[at] = p, q
                    place[p], place[q] = last, at
                    moved[g] = m + 1
                for g, m in moved.items():
                    if m < size[g]:
                        new = g + size[g] - m
                        size[new], size[g] = m, size[g] - m
                        for k in range(new, new + m):
                            group[order[k]] = new
        end = start
    out, free, done = [0] * n, {}, [False] * n
    # the empty suffix behind the text comes first
    filled = 0

    def emit(s: int) -> None:
        p = s - 1
        while p >= 0 and not done[p]:
            g = group[p]
            k = free.get(g, g)
            free[g] = k + 1
            out[k], done[p] = p, True
            p = prev[p]

    emit(n)
    while filled < n:
        emit(out[filled])
        filled += 1
    return out


Context = tuple[bytes, int, int]  # its bytes, where its anchor is in them, its number of windows


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _reach(sides: list[bytes]) -> list[int]:
    """For each text the longest prefix that it shares with any other: with a neighbour in sorted order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    common = [_shared(sides[i], sides[j]) for i, j in zip(order, order[1:])]
    out = [0] * len(sides)
    for k, i in enumerate(order):
        out[i] = max(common[k - 1] if k else 0, common[k] if k < len(common) else 0)
    return out


def repeated_windows(contexts: list[Context], length: int = LENGTH) -> list[list[int]]:
    """Starts of each context's windows that an earlier context of the list has too.

    All contexts share an anchor, so what two of them have in common is one stretch around it. A context is first
    cut to the longest stretch that any other can share, and equal cuts are settled at once. What is left is joined
    with zero symbols in between and sorted by ``linear_grouping_suffix_array``, where equal windows are neighbours.
    """
    found: list[list[int]] = [[] for _ in contexts]
    left = _reach([data[:spot][::-1] for data, spot, _ in contexts])
    right = _reach([data[spot:] for data, spot, _ in contexts])
    kept: dict[tuple[bytes, int], int] = {}
    pieces: list[tuple[int, int, bytes, int]] = []  # context, its offset, bytes, windows
    for k, (data, spot, count) in enumerate(contexts):
        a, b = spot - left[k], spot + right[k]
        windows = min(b - a - length + 1, count - a)
        if windows <= 0:
            continue
        if (data[a:b], left[k]) in kept:  # the earlier one starts as far from the anchor
            found[k] += range(a, a + windows)
        else:
            kept[data[a:b], left[k]] = k
            pieces.append((k, a, data[a:b], windows))
    if len(pieces) < 2:
        return found
    text: list[int] = []
    owner: list[int] = []
    first = []
    for k, (_, _, data, _) in enumerate(pieces):
        first.append(len(text))
        text += [b + 1 for b in data]
        text.append(0)
        owner += [k] * (len(data) + 1)
    run: list[tuple[int, int]] = []

    def settle() -> None:
        if len(run) > 1:
            head = min(run)
            for k, at in run:
                if (k, at) != head:
                    found[pieces[k][0]].append(pieces[k][1] + at)

    last = b""
    for s in linear_grouping_suffix_array(text):
        k = owner[s]
        at = s - first[k]
        if at < pieces[k][3]:
            window = pieces[k][2][at : at + length]
            if window != last:
                settle()
                last, run = window, []
            run.append((k, at))
    settle()
    return [sorted(f) for f in found]


def anchors_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``key, context, start, spot, count`` of a text's anchors: hashes of the k-gram and of all the windows it serves, where these start, the k-gram's place from there."""
    windows = len(data) - length + 1
    parts = []
    for at in range(0, max(0, windows), _BLOCK):
        here = min(_BLOCK, windows - at)
        a = np.frombuffer(data, np.uint8, here + length - 1, at)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * _POW[: len(a)], out=total[1:])
        grams = mix64((total[gram:] - total[:-gram]) * _INV[: len(a) - gram + 1])
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        wide, size = length - gram + 1, 1
        while size * 2 <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        place = (low & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(start, append=len(place))
        spot = place[start]
        whole = (total[start + count + length - 1] - total[start]) * _INV[start]
        context = mix64(whole + (((spot - start) << 8) | count).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        parts.append((grams[spot], context, start + at, spot - start, count))
    if not parts:
        return (*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


OWNER = ["doc_id", "row_hash"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), F.col("text").cast("string").alias("text"))


def _anchors(docs: DataFrame, whole: bool) -> DataFrame:
    """The anchors of all texts: their keys alone or, if ``whole``, with their contexts and places."""
    names = ["key", "context", *OWNER, "at"] if whole else ["key"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            key, context, start, spot, count = anchors_of(text)
            own = (context.view(np.int64), np.full(len(key), doc_id, np.int64), np.full(len(key), row, np.int64), start << 16 | spot << 8 | count) if whole else ()
            rows.append((key.view(np.int64), *own))
        columns = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return map_batches(_rows(docs).where(f"doc_id is not null and octet_length(text) >= {LENGTH}"), run, ", ".join(f"{n} long" for n in names))


def _with_texts(docs: DataFrame, rows: DataFrame, own: str) -> DataFrame:
    """``own``, text of each row that ``rows`` has lists for; rows that are repeated whole come once."""
    texts = texts_of(docs, rows).dropDuplicates(OWNER)
    return texts.join(rows, OWNER).select(*OWNER, "text", own)


def _contexts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """The bytes of the open contexts, from their documents."""
    wanted = open_.groupBy(*OWNER).agg(F.collect_list(F.struct("key", "m", "at")).alias("spots"))  # at most a document's anchors

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, row, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
            for s in spots:
                start, spot, count = s["at"] >> 16, s["at"] >> 8 & 255, s["at"] & 255
                rows.append((s["key"], s["m"], doc_id, row, start, spot, count, text[start : start + count + LENGTH - 1]))
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "m", *OWNER, "start", "spot", "count", "bytes"])

    return map_batches(_with_texts(docs, wanted, "spots"), run, "key long, m long, doc_id long, row_hash long, start long, spot long, count long, bytes binary")


RUNS = "doc_id long, row_hash long, start long, count long"


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Sorted numbers as first number and length of each run."""
    k = 0
    while k < len(starts):
        m = k
        while m + 1 < len(starts) and starts[m + 1] == starts[m] + 1:
            m += 1
        yield starts[k], m - k + 1
        k = m + 1


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Runs of window starts that the suffix order shows to be repeats. No group holds more than ``GROUP`` contexts;
    those of a group arrive one after another, in the order of their owners."""
    names = [c.split()[0] for c in RUNS.split(", ")]

    def group(rows: list[tuple]) -> Iterator[tuple]:
        for (_, doc_id, row, start, *_), found in zip(rows, repeated_windows([r[6:3:-1] for r in rows])):
            yield from ((doc_id, row, start + k, n) for k, n in _runs(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += group(held)
                    held = []
                held.append(row)
            if len(out) > 5000:
                yield flush()
                out = []
        out += group(held)
        yield flush()

    small_batches(contexts.sparkSession)
    dealt = contexts.select("key", *OWNER, "start", "count", "spot", "bytes")
    return dealt.repartition("key").sortWithinPartitions("key", *OWNER, "start").mapInArrow(run, RUNS)


HALF = "key binary, stretch binary, doc_id long, row_hash long, start long, spot long, count long, free long, bytes binary"


def halves(spot: int, count: int, free: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Each window has ``free`` bytes besides its group's core, which starts at ``spot`` of the context: half of them in
    front of the core or else more than the other half behind. So the core grows by these for the one windows or the
    others: their first, their number, how far their core starts and ends from the old core's bounds, bytes left free.
    """
    half = (free + 1) // 2
    cut = min(max(spot - half + 1, 0), count)  # windows in front of this one have half of the bytes in front of the core
    if cut:
        yield 0, cut, -half, 0, free - half
    if cut < count:
        yield cut, count - cut, 0, free - half + 1, half - 1


def _halved(contexts: DataFrame) -> DataFrame:
    """Two parts of each context at most, under the digests of their longer cores and of all their bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, row, start, spot, count, free, data in zip(*(c.to_pylist() for c in batch.columns)):
            for at, n, front, behind, left in halves(spot, count, free):
                part, core = data[at : at + n + LENGTH - 1], data[spot + front : spot + LENGTH - free + behind]
                place = spot + front - at
                stretch = hashlib.blake2b(part, digest_size=16, key=bytes((place, n))).digest()
                rows.append((hashlib.blake2b(core, digest_size=16, key=bytes((front + LENGTH, left))).digest(), stretch, doc_id, row, start + at, place, n, left, part))
        kinds = [pa.binary()] * 2 + [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in HALF.split(", ")])

    return map_batches(contexts.select(*OWNER, "start", "spot", "count", "free", "bytes"), run, HALF)


def _split_groups(contexts: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Runs of repeats for anchors with more contexts than ``GROUP``, as several tables.

    Every round makes the group's common core longer: a context is cut in two, by the side on which its windows have
    more of the bytes that the core lacks, and parts meet by a digest of the longer core. Equal windows are on the same
    side and have equal cores. Parts that are equal as a whole are settled by partial aggregates, and groups that have
    become small enough are sorted. The bytes that the core lacks are halved in every round; in the end (in the seventh
    round) it is the window, so this settles groups of any size.
    """
    found: list[DataFrame] = []
    contexts = contexts.withColumn("free", F.lit(LENGTH - GRAM).cast("long"))
    while not contexts.isEmpty():
        parts = scratch.write(_halved(contexts), "parts")
        first = parts.groupBy("key", "stretch").agg(F.min(F.struct(*OWNER, "start")).alias("first"))
        first = scratch.write(first.select("key", "first.*"), "part-firsts")
        sizes = scratch.write(first.groupBy("key").agg(F.count("*").alias("m")), "part-sizes")
        sized = first.join(sizes.where("m > 1"), "key", "left").select(*OWNER, "start", "m", F.lit(True).alias("is_first"))
        placed = scratch.write(parts.drop("stretch").join(sized, [*OWNER, "start"], "left"), "placed")  # by place, which no two parts share
        found.append(placed.where("is_first is null").select(*OWNER, "start", "count"))
        found.append(_sorted_groups(placed.where(F.col("m") <= GROUP)))
        contexts = placed.where(F.col("m") > GROUP)
    return found


CUT = "doc_id long, row_hash long, n_removed long, n_spans long, kept_sha256 string"


def _cut(docs: DataFrame, runs: DataFrame) -> DataFrame:
    spans = runs.groupBy(*OWNER).agg(F.collect_list(F.struct("start", "count")).alias("runs"))  # at most a document's windows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
            edge = np.zeros(len(text) + 1, np.int32)
            for r in runs:
                edge[r["start"]] += 1
                edge[r["start"] + r["count"] + LENGTH - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            rows.append((doc_id, row, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [*OWNER, "n_removed", "n_spans", "kept_sha256"])

    return map_batches(_with_texts(docs, spans, "runs"), run, CUT)


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, row_hash, start, count``: every window of LENGTH bytes that also starts earlier, as runs of window starts.

    Counts and firsts are partial aggregates, and tables are joined with an exchange on both sides, so an anchor or
    a context of any frequency is spread over tasks.
    """
    several = scratch.write(_anchors(docs, False).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    met = scratch.write(_anchors(docs, True).join(several, "key"), "anchors")
    place = F.struct(*OWNER, "at")
    first = scratch.write(met.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(place).alias("first")), "firsts")
    mixed = scratch.write(first.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    again = met.join(first.where("n > 1").select("key", "context", "first"), ["key", "context"]).where(place != F.col("first"))
    again = again.select(*OWNER, F.expr("shiftright(at, 16)").alias("start"), F.expr("at & 255").alias("count"))
    open_ = first.select("key", "first.*").join(mixed, "key")
    contexts = scratch.write(_contexts(docs, open_), "contexts")
    found = [_sorted_groups(contexts.where(F.col("m") <= GROUP)), *_split_groups(contexts.where(F.col("m") > GROUP), scratch)]
    return scratch.write(functools.reduce(DataFrame.unionByName, found, again), "runs")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row.

    Texts are UTF-8 bytes. Every byte goes that a string of LENGTH bytes covers which also starts earlier: in a
    document with a smaller doc_id, or in the same one. Strings overlap, never cross documents and are judged on
    the input. Null and short texts lose nothing; null counts as empty. Rows with a null doc_id are left as they
    are and take nothing from others. Rows that repeat a doc_id with its text count as one document; with different
    texts they are documents of their own, in the order of their hashes. No rows give no rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        cut = scratch.write(_cut(docs, repeated_runs(docs, scratch)), "cut", keep=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = _rows(docs).select(*OWNER, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return base.join(cut, OWNER, "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
