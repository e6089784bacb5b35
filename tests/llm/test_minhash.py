import random

import numpy as np

from quillmark.llm import minhash as M
from quillmark.llm.components import connected_components


def sets(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute(rows, size):
    own = {i: sets(t, size) for i, t in rows}
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {i: (len(own[i]), find(i)) for i in ids}


def corpus(seed=5):
    """Families whose members drift apart, so that hubs fail and buckets stay mixed."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(90)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.1:
                base = words
    return rows


def test_components_equal_brute_force(spark):
    for size in (2, 5):
        rows = corpus(size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, 80).collect()}
        assert got == brute(rows, size)


def test_odd_rows(spark, odd, none):
    got = M.near_duplicates(odd, 2, 80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 12
    assert rows[1].n_shingles == rows[2].n_shingles == rows[3].n_shingles == 0 and rows[1].kept
    assert (rows[4].n_shingles, rows[6].component_id, rows[6].kept, rows[7].n_shingles) == (1, 5, False, 1)
    assert rows[None].component_id is None and rows[None].kept
    assert M.near_duplicates(none, 2, 80).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    for similarity in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(20):
            union = rng.integers(0, 2**63, 3000, dtype=np.uint64)
            common, part = int(3000 * similarity), int(3000 * (1 + similarity) / 2)
            a, b = union[:part], np.concatenate([union[:common], union[part:]])
            for samples, bits in ((M.SAMPLES, M.SKETCH_BITS), (M.FINE_SAMPLES, M.FINE_BITS)):
                x, y = (M.odd_sketch(M.signature(np.unique(s), samples), bits) for s in (a, b))
                differing = int(np.bitwise_count(x ^ y).sum())
                assert differing <= M.most_bits(0.8, samples, bits)
            errors.append(M.estimate(differing, samples, bits) - similarity)
        assert abs(np.mean(errors)) < 0.02


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (100, 90), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}


def family(n=700, seed=3):
    """Near copies of one text on both sides of the similarity, so that some are linked and many stay alone."""
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(2, 9)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    return rows


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 64)  # so that buckets are dealt out in several blocks
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2)
    assert len({c for _, c in got.values()}) > 20
    kept = {r.doc_id for r in M.one_of_each(docs, 2, 80).collect()}
    assert kept == {c for _, c in got.values()}


def test_repeated_ids(spark, repeated):
    got = sorted((r["doc_id"] or 0, r["a.b"]) for r in M.one_of_each(repeated, 2, 80).collect())
    assert got == [(0, "k"), (1, "x"), (1, "y"), (3, "u"), (7, "e"), (8, "s")]
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(repeated, 2, 80).collect()}
    assert {(1, 6, 1, True), (2, 6, 1, False), (None, 6, 1, False), (None, 0, None, True)} <= rows
