"""Helpers shared by the training-data operators: shared storage, bounded batches, stable hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch for operators that carry whole texts: bounds a Python worker's memory.
TEXT_BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); on one machine a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables in the shared folder. On leaving, all go that aren't marked to be kept for the result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/quillmark"
        self.passing: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.passing:
            self.drop(path)

    def drop(self, path: str) -> None:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)

    def write(self, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts lineage and survives lost executors."""
        return self.spark.read.schema(df.schema).parquet(self.save(df, tag, keep))

    def save(self, df: DataFrame, tag: str, keep: bool = False) -> str:
        """Write ``df`` as Parquet; gives the path."""
        path = f"{self.base}/{tag}-{uuid.uuid4().hex}"
        if not keep:
            self.passing.append(path)
        df.write.parquet(path)
        return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """A table in the shared folder that the result is read from."""
    return Scratch(df.sparkSession).write(df, tag, keep=True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a smaller setting of the caller's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``fn`` may return a batch, a table or None."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Texts are looked up through a bitmap of this many bits (1 MiB): a bound that no input exceeds.
BITMAP_BITS = 1 << 23


def row_hash():
    """64-bit hash of a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row_hash, doc_id, text`` of (at least) the rows ``wanted(row_hash)``: a pass over ``docs``, no shuffle.

    The filter is a bitmap of fixed size, never a list, so it lets some other rows through. With a text goes its
    row's hash, by which it is to be joined.
    """
    bit = F.pmod(F.col("row_hash"), F.lit(BITMAP_BITS))
    maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part"))
    parts = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # at most 257 rows of 4 KiB
    bits = np.zeros((BITMAP_BITS // 32768 + 2, 4096), np.uint8)
    for r in parts:
        bits[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    # the position of a bit: bucket numbers start at 1 for bits 1.. and 0 for bit 0
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.frombuffer(held.value, np.uint8).reshape(-1, 4096)
        part, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        found = (table[part, pos >> 3] >> (pos & 7).astype(np.uint8)) & 1
        return batch.filter(pa.array(found.astype(bool))).select(["row_hash", "doc_id", "text"])

    source = docs.select(row_hash().alias("row_hash"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumns({"part": F.bitmap_bucket_number(bit), "pos": F.bitmap_bit_position(bit)})
    return map_batches(source, run, "row_hash long, doc_id long, text string")


def row_key(rows: DataFrame, *carried: str) -> tuple[list[str], dict, DataFrame]:
    """For joining ``rows(doc_id, row_hash)`` with documents: key names, the key's columns for documents, and ``rows`` with them.

    The key is the row's and not its group's, so that no group of copies meets in one task. Null ids are equal.
    """
    names = [f"_{k}_{uuid.uuid4().hex[:8]}" for k in range(3)]
    key = lambda hashed: dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), hashed)))
    return names, key(row_hash()), rows.withColumns(key(F.col("row_hash"))).select(*names, *carried)


def only_rows(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """``docs``, all columns, cut to the rows ``heads(doc_id, row_hash)``; rows that are repeated whole stay once."""
    names, own, wanted = row_key(heads)
    return docs.withColumns(own).join(wanted, names, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns))


def filter_texts(docs: DataFrame, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """``docs``, all columns, without the rows whose text ``keep`` turns down: one pass, no shuffle."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return map_batches(docs, run, docs.schema)


def crc_fold(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (the split that decides what may be learned from)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


# --- hashing ---------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_MULT, _CHUNK + 1)
_INV = _powers(pow(_MULT, -1, 2**64), _CHUNK + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit avalanche hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_chunk(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = (~_SPACE[a]).view(np.int8)
    edge = np.diff(word, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _POW[: len(a)], out=total[1:])
    return mix64((total[ends] - total[starts]) * _INV[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data`` (split at the six ASCII white-space bytes), in order.

    Works in pieces of at most 256 KiB, cut at white space, so memory follows the number of words. A single
    word longer than a piece is hashed by itself.
    """
    if len(data) <= _CHUNK:
        return _hash_chunk(data) if data else np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            view = np.frombuffer(data, np.uint8, end - at, at)
            gaps = np.flatnonzero(_SPACE[view])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one huge word
                import xxhash

                while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                    end += 1
                parts.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
                at = end
                continue
        parts.append(_hash_chunk(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of an ASCII-lower-cased text.

    Fewer words than ``size`` give one shingle, the whole sequence; no words give the empty set.
    """
    words = word_hashes(text.lower())
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    h = np.full(n, size if len(words) >= size else len(words), np.uint64)
    for k in range(min(size, len(words))):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    return np.unique(h)


def lists(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """A list column from a matrix of ``width`` values a row."""
    flat = pa.array(values.reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
