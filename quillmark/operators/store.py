"""Versioned tables of items: merge on id, tombstones, compaction, atomic commits."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import shutil
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.text import content_hash

COMPACT_ABOVE = 0.20


def checked(incoming: DataFrame) -> DataFrame:
    """``incoming`` with the last row of each id (by ``seq`` where there is one). An empty id or a null text is an error, found when run."""
    bad = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.raise_error(F.lit("an item needs an id")).cast("boolean"))
    bad = bad.when(F.col("text").isNull(), F.raise_error(F.lit("an item needs a text")).cast("boolean")).otherwise(True)
    place = F.col("seq") if "seq" in incoming.columns else F.monotonically_increasing_id()
    last = Window.partitionBy("id").orderBy(F.col("place").desc())
    rows = incoming.where(bad).withColumn("place", place).withColumn("nth", F.row_number().over(last))
    return rows.where("nth = 1").select(*(c for c in incoming.columns if c != "seq"))


def actions(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """``id, action`` for every incoming id: added, updated (the text differs) or skipped. The last of equal ids counts."""
    held = store.where("not deleted").select("id", F.col("hash").alias("held"))
    new = checked(incoming).withColumn("hash", content_hash(F.col("text")))
    kind = F.when(F.col("held").isNull(), "added").when(F.col("held") == F.col("hash"), "skipped").otherwise("updated")
    return new.join(held, "id", "left").withColumn("action", kind)


def merged(store: DataFrame, incoming: DataFrame, embed=None, carry: tuple[str, ...] = ("entities",)) -> DataFrame:
    """The store after an upsert of ``incoming(id, text, meta)``; of equal ids the last counts.

    Rows with an unchanged text keep their vector and time, get the new metadata and keep what was found out about the
    text (the keys ``carry``). Only added and changed texts are embedded. One full outer join on id; rows of neither
    side are read on unchanged.
    """
    new = checked(incoming).select("id", F.col("text").alias("new_text"), F.col("meta").alias("new_meta"), content_hash(F.col("text")).alias("new_hash"))
    both = store.join(new, "id", "full_outer")
    touched = F.col("new_hash").isNotNull()
    fresh = touched & (F.col("hash").isNull() | F.col("deleted") | (F.col("hash") != F.col("new_hash")))
    vector = embed(F.col("new_text")) if embed else F.lit(None).cast(store.schema["embedding"].dataType)
    meta = F.col("new_meta")
    for key in carry:
        held = meta_get(F.col("meta"), key)
        meta = F.when(held.isNotNull() & meta_get(F.col("new_meta"), key).isNull(), meta_with(meta, key, held)).otherwise(meta)
    picked = {
        "text": F.when(touched, F.col("new_text")).otherwise(F.col("text")),
        "meta": F.when(fresh, F.col("new_meta")).when(touched, meta).otherwise(F.col("meta")),
        "hash": F.when(touched, F.col("new_hash")).otherwise(F.col("hash")),
        "ts": F.when(fresh, F.lit(time.time())).otherwise(F.col("ts")),
        "deleted": F.when(touched, False).otherwise(F.col("deleted")),
        "embedding": F.when(fresh, vector).otherwise(F.col("embedding")),
    }
    return both.select(*(picked.get(c, F.col(c)).alias(c) for c in store.columns))


_MAP = "map<string,string>"


def meta_get(meta: Column, key: str) -> Column:
    """A value of the metadata, which is a JSON object; null if it isn't there."""
    return F.from_json(meta, _MAP)[key]


def meta_with(meta: Column, key: str, value: Column) -> Column:
    """The metadata with one value replaced or put in."""
    rest = F.map_filter(F.coalesce(F.from_json(meta, _MAP), F.create_map().cast(_MAP)), lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def updated_texts(store: DataFrame, texts: DataFrame, embed=None) -> DataFrame:
    """The store with new texts of live ids ``texts(id, text)``: embedded again, metadata kept; unknown ids change nothing."""
    live = texts.join(store.where("not deleted").select("id", "meta"), "id")
    return merged(store, live.select("id", "text", "meta"), embed)


def stale(store: DataFrame, incoming: DataFrame, group: str = "doc") -> DataFrame:
    """Live rows of documents that came in again whose id did not."""
    return store.where("not deleted").join(incoming.select(group).distinct(), group, "left_semi").join(incoming.select("id"), "id", "left_anti")


def removed(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store with tombstones on ``ids(id)``."""
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    return store.join(gone, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).select(store.columns)


def with_meta(store: DataFrame, metas: DataFrame) -> DataFrame:
    """Metadata of live ids replaced as a whole."""
    joined = store.join(metas.select("id", F.col("meta").alias("new_meta")), "id", "left")
    return joined.withColumn("meta", F.when(F.col("new_meta").isNotNull() & ~F.col("deleted"), F.col("new_meta")).otherwise(F.col("meta"))).select(store.columns)


def compacted(store: DataFrame) -> DataFrame:
    """Without tombstones, if more than a fifth of the rows are. Tables that know no tombstones stay as they are."""
    if "deleted" not in store.columns:
        return store
    share = store.agg(F.avg(F.col("deleted").cast("int"))).first()[0] or 0
    return store.where("not deleted") if share > COMPACT_ABOVE else store


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("items"), F.count_if(~F.col("deleted")).alias("open"), F.count_if("deleted").alias("tombstones"))


class StoreError(RuntimeError):
    """The store can't be opened as asked."""


class Lock:
    """One writer at a time. The kernel holds the lock, so it is gone when its process is."""

    def __init__(self, folder: str | Path):
        self.path, self.file = Path(folder, ".lock"), None

    def __enter__(self) -> Lock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        file = self.path.open("a")
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            file.close()
            raise StoreError(f"{self.path.parent} has another writer; close it there first") from e
        self.file = file
        return self

    def __exit__(self, *_) -> None:
        if self.file:
            self.file.close()
            self.file = None


def put_json(path: Path, value: dict) -> None:
    """Write a small file and swap it in, in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(path.name + ".new")
    with temp.open("w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


@dataclass
class VersionedTable:
    """A directory of Parquet versions; the manifest names the current one and is swapped in one step.

    The manifest and the lock are local or mounted files of the driver; rows are written and read by Spark alone.
    """

    spark: SparkSession
    path: str
    embedder: str = "hashed"
    dim: int = 384
    lock: Lock | None = None

    def manifest(self) -> dict:
        found = Path(self.path, "manifest.json")
        if not found.exists():
            return {"version": 0, "embedder": self.embedder, "dim": self.dim, "n": 0, "ts": 0.0}
        try:
            held = json.loads(found.read_text())
            fits = (held["embedder"], held["dim"]) == (self.embedder, self.dim)
            int(held["version"]), int(held["n"])
        except (ValueError, KeyError, TypeError) as e:
            raise StoreError(f"the manifest of {self.path} is damaged") from e
        if not fits:
            raise StoreError(f"{self.path} was built with {held['embedder']} of dimension {held['dim']}")
        return held

    def read(self) -> DataFrame:
        """The current version. Its rows must be as many as the manifest says, and vectors of its dimension."""
        held = self.manifest()
        if not held["version"]:
            raise StoreError(f"{self.path} is empty")
        rows = self.spark.read.parquet(f"{self.path}/v{held['version']}")
        if (n := rows.count()) != held["n"]:
            raise StoreError(f"{self.path} has {n} rows where its manifest says {held['n']}")
        if "embedding" not in rows.columns:
            return rows
        fits = F.col("embedding").isNull() | (F.size("embedding") == held["dim"])
        return rows.where(F.when(fits, True).otherwise(F.raise_error(F.lit(f"a vector of {self.path} isn't of dimension {held['dim']}")).cast("boolean")))

    def commit(self, rows: DataFrame) -> int:
        """Write the next version, swap the manifest, delete versions before the last. A crash leaves the old one current."""
        with contextlib.nullcontext() if self.lock and self.lock.file else Lock(self.path):
            version = self.manifest()["version"] + 1
            compacted(rows).write.mode("overwrite").parquet(f"{self.path}/v{version}")
            n = self.spark.read.parquet(f"{self.path}/v{version}").count()
            put_json(Path(self.path, "manifest.json"), {"version": version, "embedder": self.embedder, "dim": self.dim, "n": n, "ts": time.time()})
            for old in Path(self.path).glob("v[0-9]*"):
                if int(old.name[1:]) < version - 1:  # readers may still be on the last one
                    shutil.rmtree(old, ignore_errors=True)
            return version

    def stats(self) -> dict:
        """Version, rows and seconds since the last commit."""
        held = self.manifest()
        return {"version": held["version"], "items": held["n"], "age_seconds": round(time.time() - held["ts"], 2) if held["version"] else None}
