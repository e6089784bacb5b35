"""A vault of notes: synced into chunks, searched, read, related, written to; changes come through a spool."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.models import Embedder, hashed
from quillmark.operators import chunk, graph, retrieve, store
from quillmark.operators.observe import Observed
from quillmark.plans.results import Result
from quillmark.sources import files, notes
from quillmark.sources.config import Settings, flush_due
from quillmark.streaming import spool

ROWS = "id string, path string, idx long, heading string, title string, kind string, tags array<string>, mtime double, ts double, source string, text string, hash string, embedding array<double>"


def note_chunks(parsed: DataFrame) -> DataFrame:
    """``id, path, idx, heading, title, kind, tags, mtime, source, text`` of parsed notes."""
    parts = chunk.vault_chunks(parsed.select("path", "text"))
    rows = parts.join(parsed.drop("text"), "path").withColumn("idx", F.col("section_idx"))
    return rows.select(T.chunk_id(F.col("path"), F.col("idx")).alias("id"), "path", "idx", "heading", "title", "kind", "tags", "mtime", "source", "text")


@dataclass
class Vault:
    """The notes of a folder, indexed in another. One drain runs at a time; readers see the last version that was written."""

    spark: SparkSession
    settings: Settings
    embedder: Embedder = field(default_factory=hashed)
    clock: Callable[[], float] = time.time

    def __post_init__(self) -> None:
        self.root, self.seen = Path(self.settings.vault).expanduser().resolve(), Observed()
        self.table = store.VersionedTable(self.spark, str(self.settings.index_dir), self.embedder.name, self.embedder.dim)
        self.rows = self.table.read() if self.table.manifest()["version"] else self.spark.createDataFrame([], ROWS)
        self.changes, self.dirty_since = 0, None

    # --- changes ---

    def _apply(self, new: DataFrame, gone: DataFrame) -> None:
        """Rows of ``gone(path)`` go, those of ``new`` come; chunks with an unchanged text keep their vector."""
        held = self.rows.select("id", F.col("hash").alias("h"), F.col("embedding").alias("e"), F.col("ts").alias("t"))
        hashed_ = new.withColumn("hash", T.content_hash(F.col("text"))).join(held, "id", "left")
        same = F.col("h").eqNullSafe(F.col("hash"))
        fresh = hashed_.withColumn("embedding", F.when(same, F.col("e")).otherwise(self.embedder.apply(F.col("text")))).withColumn("ts", F.when(same, F.col("t")).otherwise(F.lit(self.clock())))
        kept = self.rows.join(gone.select("path").distinct(), "path", "left_anti").select(self.rows.columns)
        self.rows = kept.unionByName(fresh.select(self.rows.columns))

    def sync(self) -> dict:
        """Take over the vault as it is: new and changed notes in, vanished ones out."""
        with self.seen.call("sync"):
            found = note_chunks(files.vault_notes(self.spark, f"file://{self.root}"))
            before = self.rows.select("id", "hash")
            self._apply(found, self.rows.select("path"))
            self.changes += 1
            self.flush(force=True)
            after = self.rows.select("id", F.col("hash").alias("now"))
            state = F.when(F.col("hash").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("hash") == F.col("now"), "skipped").otherwise("updated")
            return {r["s"]: r["n"] for r in before.join(after, "id", "full_outer").groupBy(state.alias("s")).agg(F.count("*").alias("n")).collect()}

    def drain(self) -> dict:
        """Apply the spool's files in the order of their names. A file that fails stays, with all behind it, for the next call."""
        out = {"files": 0, "applied": 0, "skipped": 0}
        folder = self.settings.spool_dir
        for name in spool.names_in_order(folder):
            try:
                entries = self.spark.read.schema(spool.ENTRY).json(f"file://{folder / name}").select("*", F.lit(name).alias("file"), F.lit(0).alias("at"))
                entries = self.spark.createDataFrame(entries.collect(), entries.schema)  # one file of changes
                last = spool.latest(spool.valid(entries))
                made = last.where("op = 'file'").select("path", F.posexplode("chunks").alias("idx", "c"))
                meta = F.from_json("c.meta", "title string, kind string, tags array<string>, mtime double, source string, heading string")
                new = made.select(F.col("c.id").alias("id"), "path", F.col("idx").cast("long").alias("idx"), meta.alias("m"), F.col("c.text").alias("text"))
                self._apply(new.select("id", "path", "idx", "m.heading", "m.title", "m.kind", "m.tags", "m.mtime", "m.source", "text"), last.select("path"))
                self.changes += last.count()
                self.flush(force=True)
            except Exception as e:
                self.seen.error("embed", f"drain {name}", e)
                self.rows = self.table.read() if self.table.manifest()["version"] else self.spark.createDataFrame([], ROWS)
                break
            out["files"] += 1
            out["applied"] += last.count()
            out["skipped"] += spool.poison(entries).count()
            spool.done(folder, name)
        spool.swept(folder)
        return out

    def flush(self, force: bool = False) -> bool:
        """Write a version if enough has changed, or waited long enough, or it is wanted now."""
        now = self.clock()
        self.dirty_since = self.dirty_since if self.dirty_since is not None or not self.changes else now
        if not flush_due(self.settings, self.changes, now - (self.dirty_since or now), force):
            return False
        self.table.commit(self.rows)
        self.rows, self.changes, self.dirty_since = self.table.read(), 0, None
        return True

    # --- verbs ---

    def search(self, question: str, k: int = 5, kinds: list[str] | None = None, min_score: float = 0.0) -> Result:
        """The chunks nearest to a question, of some kinds if given."""
        if not question.strip() or k < 1:
            return Result(question)
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string").withColumn("qv", self.embedder.apply(F.col("text")))
        keyed = self.rows.withColumn("key", F.xxhash64("id"))
        found = retrieve.dense_topk(asked, keyed.select(F.col("key").alias("id"), "embedding", "kind"), k, min_score, kinds)
        hits = found.join(keyed.drop("embedding").withColumnRenamed("id", "name"), found.id == F.col("key")).drop("id")
        return Result.of(question, hits.select("rank", F.col("name").alias("id"), "path", F.col("title").alias("doc"), "heading", "kind", "tags", "text", "cos", F.col("cos").alias("fused")))

    def get(self, path: str) -> dict:
        """A whole note with what is known of it from its first chunk."""
        text = notes.get(self.root, path)
        row = self.rows.where(F.col("path") == path).orderBy("idx").drop("embedding", "text").first()
        return {"path": path, "text": text, **(row.asDict() if row else {})}

    def related(self, path: str, k: int = 5) -> list[dict]:
        """Notes near to a note's first chunk, blended with its links. The cut comes first: what has no chunk is left out of it, not replaced."""
        keyed = self.rows.withColumn("key", F.xxhash64("id"))
        first = keyed.where(F.col("path") == path).orderBy("idx").limit(1).select(F.col("key").alias("query_id"), F.col("embedding").alias("qv"))
        near = retrieve.dense_topk(first, keyed.select(F.col("key").alias("id"), "embedding"), retrieve.pool_size(k), exclude_self=True)
        pairs = near.join(keyed.select(F.col("key").alias("id"), F.col("path").alias("other")), "id").select(F.lit(path).alias("doc"), "other", "cos")
        linked = graph.resolve_links(self.rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "text")))["text"], "\n").alias("text")))
        out = linked.where(F.col("path") == path).select(F.col("resolved").alias("other")).unionByName(linked.where(F.col("resolved") == path).select(F.col("path").alias("other"))).distinct()
        blend = graph.related(pairs, out.select(F.lit(path).alias("doc"), "other", F.lit(1.0).alias("weight")), k)
        known = self.rows.groupBy(F.col("path").alias("other")).agg(F.min_by("title", "idx").alias("title"), F.min_by("kind", "idx").alias("kind"))
        rows = blend.join(known, "other").orderBy("rank").collect()
        return [{"path": r["other"], "title": r["title"], "kind": r["kind"], "score": round(r["related"], 4), "via": r["via"]} for r in rows]

    def by_tag(self, tags: list[str], limit: int = 50) -> list[dict]:
        """Notes with any of the tags, the latest first."""
        return self._latest(self.rows.where(T.has_any_tag(F.col("tags"), tags)), limit)

    def recent(self, n: int = 10, kind: str | None = None) -> list[dict]:
        """The notes changed last, of one kind if given: by the file's time, else by that of indexing."""
        return self._latest(self.rows if kind is None else self.rows.where(F.col("kind") == kind), n)

    def _latest(self, rows: DataFrame, n: int) -> list[dict]:
        when: Column = F.coalesce(F.nullif("mtime", F.lit(0.0)), "ts")
        first = rows.groupBy("path").agg(F.min_by("title", "idx").alias("title"), F.min_by("kind", "idx").alias("kind"), F.min_by("tags", "idx").alias("tags"), F.max(when).alias("when"))
        return [r.asDict() for r in first.orderBy(F.desc("when"), "path").limit(max(0, n)).collect()]

    def remember(self, text: str, tags: tuple[str, ...] = (), title: str | None = None) -> str:
        """A new note in the inbox, indexed at once; gives its path."""
        path = notes.remember(self.root, text, tags, title)
        found = files.vault_notes(self.spark, f"file://{self.root}").where(F.col("path") == path)
        self._apply(note_chunks(found), found.select("path"))
        self.changes += 1
        self.flush(force=True)
        return path

    def stats(self) -> dict:
        count = self.rows.agg(F.count_distinct("path").alias("notes"), F.count("*").alias("chunks")).first().asDict()
        return self.table.stats() | count | {"pending": len(spool.names_in_order(self.settings.spool_dir)), "observed": self.seen.stats()}
