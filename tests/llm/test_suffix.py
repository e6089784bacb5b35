import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import suffix_dedup as S


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_equals_sorting(text):
    assert S.linear_grouping_suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        edge = np.zeros(len(data) + 1, int)
        for k in range(len(data) - S.LENGTH + 1):
            w = data[k : k + S.LENGTH]
            if w in seen:
                edge[k] += 1
                edge[min(len(data), k + S.LENGTH)] -= 1
            seen.add(w)
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_removal_equals_brute_force(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((99, 100, 101, 140, 400)))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] if rng.random() < 0.5 else p)
            parts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))))
        rows.append((i, "".join(parts)))
    rows += [(80, "ab" * 400), (81, "ab" * 300), (82, None), (83, ""), (84, "a" * 100), (85, "a" * 260)]
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 150)
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(900))
    parts = S.anchors_of((text * 2).encode())
    assert int(parts[4].sum()) == 1800 - S.LENGTH + 1


def test_odd_rows(spark, odd, none):
    got = S.remove_repeats(odd)
    assert got.count() == 12 and S.remove_repeats(none).count() == 0
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and rows[7].n_removed > 140_000 and rows[9].n_removed == 300 - 1 and rows[None].n_removed == 0


def test_repeated_ids(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(500))
    schema = "doc_id long, text string"
    got = sorted(tuple(r)[:4] for r in S.remove_repeats(spark.createDataFrame([(1, passage), (2, passage), (2, None)], schema)).collect())
    assert got == [(1, 500, 0, 0), (2, 0, 0, 0), (2, 500, 500, 1)]
    other = passage[::-1]
    got = sorted(tuple(r)[:4] for r in S.remove_repeats(spark.createDataFrame([(2, passage), (2, other), (2, "short"), (None, passage)], schema)).collect() if r.doc_id)
    assert got == [(2, 5, 0, 0), (2, 500, 0, 0), (2, 500, 0, 0)]


def test_anchors_with_many_contexts(spark, monkeypatch):
    """A common line in ever different surroundings, more often than a task sorts."""
    monkeypatch.setattr(S, "GROUP", 8)
    rng = random.Random(6)
    any_text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = any_text(70), any_text(130)
    rows = [(k, any_text(90) + (line if k % 3 else passage) + any_text(90)) for k in range(60)] + [(60, any_text(10) + line + any_text(70))]
    rows += [(61, rows[1][1][40:220]), (62, rows[5][1])]
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_halves_hold_every_window_once():
    for free in range(1, S.LENGTH - S.GRAM + 1):
        for spot in range(free + 1):
            for count in range(1, spot + 2):
                parts = list(S.halves(spot, count, free))
                assert [k for at, n, *_ in parts for k in range(at, at + n)] == list(range(count))
                for at, n, front, behind, left in parts:
                    low, high = spot + front, spot + S.LENGTH - free + behind
                    assert high - low == S.LENGTH - left and 2 * left <= free
                    assert all(k <= low and high <= k + S.LENGTH for k in range(at, at + n))


def test_large_groups_are_not_taken_apart_into_windows(spark, monkeypatch):
    """Anchors with many contexts give two rows a context and round, not one for each of its windows."""
    made = []

    def counted(df, run, schema):
        out = whole(df, run, schema)
        made.append(out.count() if "start long" in schema and "key long" not in schema else 0)
        return out

    whole = S.map_batches
    monkeypatch.setattr(S, "GROUP", 8)
    monkeypatch.setattr(S, "map_batches", counted)
    rng = random.Random(7)
    any_text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = any_text(60)
    rows = [(k, any_text(90) + line + any_text(90)) for k in range(100)]
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and 0 < sum(made) < 2500
