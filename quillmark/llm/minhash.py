"""Near-duplicate detection: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

Documents with one shingle set are one class, named by the number of one of its rows. Only rows that grow with the
number of classes and their buckets are shuffled: pairs are held against each other inside a worker, block by block,
and what leaves it are links that join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, lists, map_batches, mix64, only_rows, row_hash, shingle_set, small_batches, text_bytes, texts_of
from quillmark.llm.components import connected_components

#: 40 bands of 5 samples miss a pair of similarity 0.8 with probability (1 - 0.8^5)^40 < 2e-7.
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: The finer sketches of classes whose buckets stay mixed, which rule out all but the highest similarities.
FINE_SAMPLES, FINE_BITS = 2400, 4096
#: A mixed bucket is dealt out in blocks of about so many classes and so many shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20

_RNG = np.random.Generator(np.random.PCG64(7411))
_A = _RNG.integers(0, 2**31, FINE_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROW_MIX = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_SALT = mix64(np.arange(1000, 1000 + FINE_SAMPLES, dtype=np.uint64))
#: Distinct sets that a worker holds while it confirms pairs, in bytes of text.
HELD_BYTES = 16 << 20


def signature(shingles: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The MinHash samples of a non-empty set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = 1024 * SAMPLES // samples
    for at in range(0, len(x), step):
        np.minimum(best, np.multiply.outer(_A[:samples], x[at : at + step]).min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    return mix64((samples.reshape(BANDS, ROWS).astype(np.uint64) * _ROW_MIX).sum(axis=1, dtype=np.uint64) + _BAND)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Each (index, sample) flips one of ``bits`` bits; the parities as 64-bit words."""
    at = mix64(samples.astype(np.uint64) + _SALT[: len(samples)]) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def estimate(differing: int, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """Similarity estimated from the population count of two sketches' XOR."""
    share = 1 - 2 * min(differing, bits // 2 - 1) / bits
    return 1 + bits / (4 * samples) * float(np.log(share))


def most_bits(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, deviations: float = 6.5) -> int:
    """Differing bits that a pair of this similarity exceeds only by so many deviations (6.5: one in 10^10 pairs)."""
    flips, keep = 2 * samples * (1 - similarity), lambda f: bits / 2 * (1 - np.exp(-2 * f / bits))
    spread = 2 * np.sqrt(samples * similarity * (1 - similarity))
    noise = np.sqrt((keep(flips + spread) - keep(flips)) ** 2 + keep(flips) * 0.4)
    return int(np.ceil(keep(flips) + deviations * noise))


FEATURES = "row_hash long, doc_id long, n_shingles long, fa long, fb long, bands array<long>, sketch array<long>"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(row_hash().alias("row_hash"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def features(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: size and 128-bit fingerprint of its shingle set, band keys and odd sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        n, fa, fb = (np.zeros(rows, np.uint64) for _ in range(3))
        bands, sketch = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, 8), np.uint64)
        for i, text in enumerate(text_bytes(batch.column(2))):
            s = shingle_set(text, shingle)
            n[i] = len(s)
            if len(s):
                fa[i], fb[i] = s.sum(), mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum()
                mins = signature(s)
                bands[i], sketch[i] = band_keys(mins), odd_sketch(mins)
        as_long = lambda x: pa.array(x.view(np.int64))
        columns = [batch.column(0), batch.column(1), as_long(n), as_long(fa), as_long(fb), lists(bands.view(np.int64), BANDS, pa.int64()), lists(sketch.view(np.int64), 8, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FEATURES.split(", ")])

    return map_batches(_rows(docs), run, FEATURES)


def _differing(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(8):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _nearest_hubs(shared: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: for each class the most similar, by odd sketch, of the hubs that its buckets drew."""
    drawn = shared.where("h <> hub").select("node", "hub").distinct()
    own = sketches.select("node", F.col("sketch").alias("sa"))
    other = sketches.select(F.xxhash64("node").alias("hub"), F.col("node").alias("to"), F.col("sketch").alias("sb"))
    both = drawn.join(own, "node").join(other, "hub").withColumn("bits", _differing("sa", "sb"))
    near = both.where(F.col("bits") <= most_bits(similarity)).select("node", "to", "bits")
    return near.groupBy("node").agg(F.min_by("to", "bits").alias("b")).select(F.col("node").alias("a"), "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, n, bands, fine, shingles`` of the classes ``wanted(node, n, row_hash, bands)``: fine sketch and whole set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle) for t in text_bytes(batch.column(1))]
        fine = [odd_sketch(signature(s, FINE_SAMPLES), FINE_BITS).tobytes() if len(s) else bytes(FINE_BITS // 8) for s in sets]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fine, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["row_hash", "n", "fine", "shingles"])

    found = map_batches(texts_of(docs, wanted).select("row_hash", "text"), run, "row_hash long, n long, fine binary, shingles binary")
    return found.join(wanted, ["row_hash", "n"]).dropDuplicates(["node"]).select("node", "n", "bands", "fine", "shingles")  # rows that are repeated whole


def confirmed(docs: DataFrame, pairs: DataFrame, hashes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * |A and B| >= percent * |A or B| on full sets, by joining both texts to each pair."""
    named = pairs.join(hashes.select(F.col("node").alias("a"), F.col("row_hash").alias("ra")), "a").join(hashes.select(F.col("node").alias("b"), F.col("row_hash").alias("rb")), "b")
    ids = named.select(F.col("ra").alias("row_hash")).unionByName(named.select(F.col("rb").alias("row_hash")))
    texts = texts_of(docs, ids)
    both = named.join(texts.select(F.col("row_hash").alias("rb"), F.col("text").alias("tb")), "rb")
    both = both.join(texts.select(F.col("row_hash").alias("ra"), F.col("text").alias("ta")), "ra").select("a", "b", "ta", "tb")

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def of(text: bytes) -> np.ndarray:
            nonlocal size
            if (found := held.get(text)) is None:
                if size > HELD_BYTES:
                    held.clear()
                    size = 0
                found = held[text] = shingle_set(text, shingle)
                size += len(text)
            return found

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (ta, tb) in enumerate(zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)))):
                one, other = of(ta), of(tb)
                both = np.concatenate([one, other])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    small_batches(docs.sparkSession)
    return both.mapInArrow(run, "a long, b long").distinct()


def _labelled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with a component ``c`` for each class: the hub of its hub's hub, as far as links lead there.

    A hub has a smaller hash than the classes it is held against, so links form a forest. Stopping early leaves
    two labels for one component, which costs work and loses nothing.
    """
    up = links.select(F.col("a").alias("node"), F.col("b").alias("c"))
    step = links.select(F.col("a").alias("c"), F.col("b").alias("next"))
    for _ in range(3):
        up = up.join(step, "c", "left").select("node", F.coalesce("next", "c").alias("c"))
    return shared.join(up, "node", "left").select("band", "node", "n", F.coalesce("c", "node").alias("c"))


def _dealt(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries of the buckets that hold more than one component, dealt out in blocks ``(band, i, j)``.

    Block i of what lies outside a bucket's largest component (``asks``) meets block j of the whole bucket
    (``told``). A block's size is bounded whatever the bucket's, and so is what a task holds.
    """
    parts = entries.groupBy("band", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    whole = parts.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max_by("c", "m").alias("home"), F.max("m").alias("most"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    share = (F.col("m") - F.col("most")) / F.col("m")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    whole = whole.where("lo <> hi").select("band", "home", blocks.alias("told"), F.greatest(F.lit(1), F.ceil(blocks * share)).cast("int").alias("asks"))
    whole = scratch.write(whole, "mixed")
    rest = F.col("c") != F.col("home")
    own = lambda seed, count: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")
    told = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), (rest & (i == F.col("i"))).alias("asks"), F.lit(True).alias("told")))
    asks = F.transform(F.sequence(F.lit(0), F.col("told") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("told")))
    asks = F.when(rest, F.filter(asks, lambda x: x["j"] != F.col("j"))).otherwise(F.array().cast("array<struct<i:int,j:int,asks:boolean,told:boolean>>"))
    placed = entries.join(whole, "band").withColumns({"i": own(1, "asks"), "j": own(2, "told")})
    placed = placed.select("band", "node", "c", rest.alias("rest"), F.explode(F.concat(told, asks)).alias("at"))
    return placed.select("band", "at.i", "at.j", "node", "c", "rest", "at.asks", "at.told")


BLOCK = ["band", "i", "j"]


def _by_block(rows: DataFrame, own, schema: str) -> DataFrame:
    """``own(columns)`` for the rows of each block, which arrive one after another."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            return own(pa.Table.from_batches(held).combine_chunks()) if held else None

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                key = tuple(keys[:, lo].tolist())
                if key != last and held:
                    if (out := flush()) is not None:
                        yield from out.to_batches()
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if (out := flush()) is not None:
            yield from out.to_batches()

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def candidates(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``dealt`` that have a partner of another component whose fine sketch doesn't rule the similarity out.

    A pair is looked at in the first of the bands that it shares.
    """
    limit = most_bits(percent / 100, FINE_SAMPLES, FINE_BITS, 5.0)

    def own(table: pa.Table) -> pa.Table | None:
        node, c, n, rest, asks, told = _columns(table, "node", "c", "n", "rest", "asks", "told")
        band = table.column("band")[0].as_py()
        fine = _matrix(table.column("fine"), FINE_BITS // 64)
        bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        (whom,) = np.nonzero(told)
        hit = np.zeros(len(node), bool)
        for x in np.flatnonzero(asks).tolist():
            y = whom[(c[whom] != c[x]) & (~rest[whom] | (node[whom] > node[x])) & (100 * n[whom] >= percent * n[x]) & (100 * n[x] >= percent * n[whom])]
            y = y[np.bitwise_count(fine[y] ^ fine[x]).sum(axis=1, dtype=np.int64) <= limit]
            y = y[bands[x][(bands[y] == bands[x]).argmax(axis=1)] == band]
            if len(y):
                hit[x] = hit[y] = True
        return table.select([*BLOCK, "node", "c", "rest", "asks", "told"]).filter(pa.array(hit)) if hit.any() else None

    rows = dealt.join(sets.select("node", "n", "bands", "fine"), "node").select(*BLOCK, "node", "c", "n", "rest", "asks", "told", "fine", "bands")
    return _by_block(rows, own, "band long, i int, j int, node long, c long, rest boolean, asks boolean, told boolean")


def joining_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between components that the candidates' full sets confirm, a spanning forest of each block."""

    def own(table: pa.Table) -> pa.Table | None:
        node, c, rest, asks, told = _columns(table, "node", "c", "rest", "asks", "told")
        own_sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in own_sets])
        whole, code = np.unique(np.concatenate(own_sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        member = np.zeros(len(whole), np.int32)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        out: list[tuple[int, int]] = []
        for x in np.flatnonzero(asks).tolist():
            mine = code[first[x] : first[x] + n[x]]
            member[mine] = 1
            common = np.add.reduceat(member[code], first)
            member[mine] = 0
            linked = told & (c != c[x]) & (~rest | (node > node[x])) & (100 * common >= percent * (n + n[x] - common))
            for y in np.flatnonzero(linked).tolist():
                u, v = find(int(c[x])), find(int(c[y]))
                if u != v:
                    parent[u] = v
                    out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())}) if out else None

    whole = rows.join(sets.select("node", "shingles"), "node").select(*BLOCK, "node", "c", "rest", "asks", "told", "shingles")
    return _by_block(whole, own, "a long, b long").distinct()


def linked_classes(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents' features, and ``fa, fb, node, component_id, part`` of every class: what it is linked with.

    1. Equal sets form classes by a 128-bit fingerprint (partial aggregation: any number of copies is cheap).
    2. Every bucket of a band draws one of its classes by hash, and each class is checked against the most similar
       one, by sketch, that its buckets drew: a star and not all pairs.
    3. Buckets that still hold more than one component are dealt out in blocks. Inside a block, pairs of different
       components are sifted by fine sketches; those left bring their full sets along, and links that join two
       components come out. Every pair of different components in a bucket is looked at, in one of its bands.
    """
    small_batches(docs.sparkSession)
    feats = scratch.write(features(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "features", keep=True)
    named = feats.where("n_shingles > 0")
    classes = scratch.write(named.groupBy("fa", "fb").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")), "classes", keep=True)
    reps = feats.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    reps = scratch.write(reps.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "row_hash", "bands", "sketch"), "reps")
    entries = reps.select("node", "n", F.explode("bands").alias("band"))
    hubs = entries.groupBy("band").agg(F.count("*").alias("m"), F.min(F.xxhash64("node")).alias("hub"))
    hubs = scratch.write(hubs.where("m > 1").select("band", "hub"), "hubs")
    shared = scratch.write(entries.withColumn("h", F.xxhash64("node")).join(hubs, "band"), "buckets")
    reps = scratch.write(reps.join(shared.select("node").distinct(), "node", "left_semi"), "active")

    near = scratch.write(_nearest_hubs(shared, reps, percent / 100), "pairs")
    links = scratch.write(confirmed(docs, near, reps.select("node", "row_hash"), shingle, percent), "links")
    dealt = scratch.write(_dealt(_labelled(shared, links), scratch), "dealt")
    wanted = reps.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "n", "row_hash", "bands")
    sets = scratch.write(shingle_sets(docs, wanted, shingle), "sets")
    rows = scratch.write(candidates(dealt, sets, percent), "candidates")
    links = links.unionByName(scratch.write(joining_links(rows, sets, percent), "links"))
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    labelled = classes.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    labelled = scratch.write(labelled, "labelled")
    least = labelled.groupBy("part").agg(F.min("rep").alias("component_id"))
    return feats, scratch.write(labelled.join(least, "part").select("fa", "fb", "component_id", "part"), "labels", keep=True)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id, kept``, one row per input row.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z. Documents whose shingle sets
    have a similarity of ``percent`` / 100 or more are linked; ``component_id`` is the smallest doc_id reachable
    and ``kept`` marks it. Null or wordless texts have an empty set and stand alone. Rows that repeat a doc_id are
    judged each by its own text. A row with a null doc_id takes part: it goes where a row with an id is reachable,
    and is kept, with a null component, where none is. Other columns are ignored, no rows give no rows.

    A link is lost only where hashing is against it: a pair of similarity 0.8 shares no band with probability
    2e-7, and the sketches turn it down with probability 1e-10 and 3e-7; higher similarities are safer.
    """
    with Scratch(docs.sparkSession) as scratch:
        feats, labels = linked_classes(docs, shingle, percent, scratch)
    out = feats.join(labels, ["fa", "fb"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns: one row of each group of linked documents, and every row without words.

    The row with the smallest doc_id stays (a null id only where the group has no other). Where rows repeat that id
    with different texts, it is the one with the smallest hash; rows that are repeated whole stay once.
    """
    with Scratch(docs.sparkSession) as scratch:
        feats, labels = linked_classes(docs, shingle, percent, scratch)
        rows = feats.where("n_shingles > 0").select("fa", "fb", "doc_id", "row_hash").join(labels, ["fa", "fb"])
        heads = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("part", "doc_id").agg(F.min("row_hash").alias("row_hash"))
        heads = scratch.write(heads.select("doc_id", "row_hash").unionByName(feats.where("n_shingles = 0").select("doc_id", "row_hash")), "heads", keep=True)
    return only_rows(docs, heads)
