"""Topics and conversations on disk: a folder of versioned tables, opened, changed, moved and closed."""

from __future__ import annotations

import json
import re
import shutil
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.models import Embedder, hashed
from quillmark.operators import graph, keyword, store
from quillmark.operators.observe import Observed
from quillmark.plans.library import CHUNKS, Library, slug
from quillmark.plans.results import Result
from quillmark.sources import files

#: Topics that are open in this process, by folder: opening one twice gives the same.
_OPEN: dict[Path, Topic] = {}


@dataclass
class Added:
    """What an ``add`` did, chunk by chunk."""

    added: int = 0
    updated: int = 0
    skipped: int = 0
    removed: int = 0

    def __bool__(self) -> bool:
        return bool(self.added or self.updated or self.removed)

    def to_dict(self) -> dict:
        return dict(vars(self))


def documents(spark: SparkSession, source, name: str | None = None) -> DataFrame:
    """``doc, text`` of a DataFrame, a mapping, a folder, a file, a list of these, or a text."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Mapping):
        return files.from_mapping(spark, dict(source))
    if isinstance(source, str | Path):
        path = Path(source) if isinstance(source, Path) or "\n" not in source and len(source) < 1000 else None
        if path is not None and path.is_dir():
            return files.text_folder(spark, f"file://{path.resolve()}")
        if path is not None and path.is_file():
            return files.from_mapping(spark, {name or path.name: path.read_text(encoding="utf-8")})
        if isinstance(source, Path):
            raise FileNotFoundError(source)
        return files.from_text(spark, source, name)
    if isinstance(source, Iterable):
        parts = [documents(spark, s if not isinstance(s, str) or not Path(s).exists() else Path(s)) for s in source]
        if parts:
            out = parts[0].select("doc", "text")
            for p in parts[1:]:
                out = out.unionByName(p.select("doc", "text"))
            return out
    raise TypeError(f"{type(source).__name__} is no source of documents")


class Topic:
    """One topic in a folder: chunks and links as versioned tables, a keyword index of the current version, ``topic.json``.

    The folder is locked for as long as the topic is open. Changes are written when they are made, so that a plan never
    grows over several of them; a crash leaves the last version.
    """

    def __init__(self, spark: SparkSession, path: str | Path, name: str, embedder: Embedder | None = None, chunk_words: int = 120, overlap: int = 20, kind: str = "topic"):
        self.spark, self.path, self.name, self.slug = spark, Path(path).resolve(), name, slug(name)
        self.embedder, self.seen = embedder or hashed(), Observed()
        self.lock = store.Lock(self.path)
        self.lock.__enter__()
        try:
            table = lambda at: store.VersionedTable(spark, str(self.path / at), self.embedder.name, self.embedder.dim, self.lock)
            self.rows, self.links = table("chunks"), table("edges")
            self.library = Library(spark, None, None, self.embedder, chunk_words, overlap)
            self._load()
        except Exception:
            self.lock.__exit__()
            raise
        if not (self.path / "topic.json").exists():
            store.put_json(self.path / "topic.json", {"name": name, "kind": kind, "created": time.time()})
        _OPEN[self.path] = self

    def _load(self) -> None:
        chunks = self.rows.read() if self.rows.manifest()["version"] else None
        edges = self.links.read() if self.links.manifest()["version"] else None
        old = self.library
        self.library = Library(self.spark, chunks, edges, self.embedder, old.chunk_words, old.overlap)

    def _write(self, changed: Library) -> None:
        version = self.rows.commit(changed.chunks)
        self.links.commit(changed.edges)
        self._load()
        live = self.library.live(archived=True).select(F.xxhash64("id").alias("id"), "topic", "text")
        index = self.path / "keyword"
        keyword.postings(live).write.mode("overwrite").parquet(str(index / f"v{version}" / "postings"))
        keyword.topic_sizes(live).write.mode("overwrite").parquet(str(index / f"v{version}" / "sizes"))
        store.put_json(index / "index.json", {"version": version, "n": self.rows.manifest()["n"]})
        for old in index.glob("v[0-9]*"):
            if old.name != f"v{version}":
                shutil.rmtree(old, ignore_errors=True)

    def keyword_index(self) -> tuple[DataFrame, DataFrame] | None:
        """The stored postings and sizes, if they are of the current version; otherwise they are built in the query."""
        held, now = read_json(self.path / "keyword" / "index.json"), self.rows.manifest()
        if not held or (held.get("version"), held.get("n")) != (now["version"], now["n"]):
            return None
        at = self.path / "keyword" / f"v{held['version']}"
        return self.spark.read.parquet(str(at / "postings")), self.spark.read.parquet(str(at / "sizes"))

    # --- changes ---

    def add(self, source, name: str | None = None, reply: Callable[[Column], Column] | None = None) -> Added:
        """Documents in any form that ``documents`` takes; with ``reply`` a model enriches new chunks."""
        with self.seen.call("add"):
            before = self.library.live(archived=True).select("id", "hash")
            self._write(self.library.add(self.name, documents(self.spark, source, name).select("doc", "text"), reply))
            after = self.library.live(archived=True).select("id", F.col("hash").alias("now"))
            state = F.when(F.col("hash").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("hash") == F.col("now"), "skipped").otherwise("updated")
            return Added(**{r["state"]: r["n"] for r in before.join(after, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n")).collect()})

    def forget(self, doc: str) -> int:
        """Drop a document; gives the number of its chunks."""
        with self.seen.call("forget"):
            n = self.library.live(archived=True).where(F.col("doc") == doc).count()
            if n:
                self._write(self.library.forget(self.name, doc))
            return n

    def update_text(self, item: str, text: str) -> bool:
        """A chunk with a new text, embedded again, its metadata kept; False if there is no such chunk."""
        if self.library.live(archived=True).where(F.col("id") == item).isEmpty():
            return False
        new = self.spark.createDataFrame([(item, text)], "id string, text string")
        self._write(self.library._with(store.updated_texts(self.library.chunks, new, self.embedder.apply)))
        return True

    def link(self, src: str, dst: str, relation: str = "related", weight: float = 1.0) -> None:
        self._write(self.library.link(src, dst, relation, weight))

    def unlink(self, src: str, dst: str, relation: str | None = None) -> bool:
        gone = (F.col("src") == src) & (F.col("dst") == dst) & (F.lit(relation is None) | F.col("relation").eqNullSafe(F.lit(relation)))
        found = not self.library.edges.where(gone).isEmpty()
        if found:
            self._write(self.library.unlink(src, dst, relation))
        return found

    # --- reading ---

    def questions(self, texts: list[str]) -> DataFrame:
        return self.library.questions(texts)

    def ask(self, question: str | DataFrame, k: int = 5, **how):
        """Hits of one question as a ``Result``, or of a table of questions as a table."""
        with self.seen.call("ask"):
            if isinstance(question, DataFrame):
                return self.library.ask(question, k, archived=True, index=self.keyword_index(), **how)
            if not question.strip() or k < 1:
                return Result(question)
            return Result.of(question, self.library.ask(self.questions([question]), k, archived=True, index=self.keyword_index(), **how))

    def docs(self) -> list[str]:
        """Names of the documents, sorted; one row each."""
        return [r["doc"] for r in self.library.live(archived=True).select("doc").distinct().orderBy("doc").collect()]

    def edges(self) -> DataFrame:
        return self.library.edges

    def nodes(self) -> DataFrame:
        return graph.both_ways(self.library.edges).select(F.col("at").alias("node")).distinct()

    def linked_pairs(self) -> int:
        """Pairs of nodes with a link, whatever its relations."""
        return self.library.edges.select("src", "dst").distinct().count()

    def state_key(self) -> tuple[int, int, int]:
        """Changes whenever rows or links do."""
        now = self.rows.manifest()
        return now["version"], now["n"], self.links.manifest()["version"]

    def stats(self) -> dict:
        counted = store.stats(self.library.chunks).first().asDict()
        return self.rows.stats() | counted | {"docs": self.library.live(archived=True).select("doc").distinct().count(), "observed": self.seen.stats()}

    def __len__(self) -> int:
        return self.library.live(archived=True).count()

    def __contains__(self, doc: str) -> bool:
        return self.library.has_doc(self.name, doc)

    def __repr__(self) -> str:
        return f"topic({self.name!r}: {len(self)} chunks, {self.path})"

    def close(self) -> None:
        self.lock.__exit__()
        _OPEN.pop(self.path, None)

    def __enter__(self) -> Topic:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read_json(path: Path) -> dict:
    """A small file's object; a missing or damaged one is empty."""
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def topic(spark: SparkSession, path: str | Path, name: str | None = None, embedder: Embedder | None = None, **how) -> Topic:
    """Open a topic's folder, or create it. In one process the same folder gives the same topic."""
    at = Path(path).resolve()
    if at in _OPEN:
        return _OPEN[at]
    return Topic(spark, at, name or read_json(at / "topic.json").get("name") or at.name, embedder, **how)


@dataclass
class Home:
    """A folder of topics, ``_archive`` with those put away, and ``_sessions`` with conversations, which ``ask`` never searches."""

    spark: SparkSession
    path: str | Path
    embedder: Embedder = field(default_factory=hashed)

    def __post_init__(self) -> None:
        self.path = Path(self.path).resolve()
        self.path.mkdir(parents=True, exist_ok=True)

    def _dir(self, name: str, archived: bool = False) -> Path:
        return self.path / "_archive" / slug(name) if archived else self.path / slug(name)

    def _find(self, name: str) -> Path:
        for archived in (False, True):
            if (at := self._dir(name, archived)).is_dir():
                return at
        raise KeyError(f"no topic {name!r}; there are {', '.join(self.names(True)) or 'none'}")

    def names(self, archived: bool = False) -> list[str]:
        """Topics' short names, sorted."""
        own = [p.name for p in self.path.iterdir() if p.is_dir() and p.name[0] not in "_."]
        put_away = [p.name for p in (self.path / "_archive").glob("*") if p.is_dir()] if archived else []
        return sorted({*own, *put_away})

    def topic(self, name: str, **how) -> Topic:
        """Open or create; a topic that was put away is opened where it is."""
        at = self._dir(name, True) if self._dir(name, True).is_dir() and not self._dir(name).is_dir() else self._dir(name)
        return topic(self.spark, at, name, self.embedder, **how)

    def session(self, name: str, **how):
        from quillmark.plans.conversation import Session

        return Session(self.spark, self.path / "_sessions" / slug(name), name, self.embedder, **how)

    def sessions(self) -> list[str]:
        return sorted(read_json(p / "topic.json").get("name", p.name) for p in (self.path / "_sessions").glob("*") if p.is_dir())

    def _move(self, name: str, archived: bool) -> Path:
        here, there = self._dir(name, not archived), self._dir(name, archived)
        if not here.is_dir():
            raise KeyError(f"no topic {name!r} to move; there are {', '.join(self.names(True)) or 'none'}")
        if there.exists():
            raise FileExistsError(there)
        if here in _OPEN:
            _OPEN[here].close()
        there.parent.mkdir(exist_ok=True)
        here.rename(there)
        return there

    def archive(self, name: str) -> Path:
        return self._move(name, True)

    def restore(self, name: str) -> Path:
        return self._move(name, False)

    def delete(self, name: str) -> None:
        at = self._find(name)
        if at in _OPEN:
            _OPEN[at].close()
        shutil.rmtree(at)

    def catalog(self, archived: bool = False) -> list[dict]:
        """``name, slug, archived, chunks`` from the manifests alone; no table is read."""
        out = []
        for short in self.names(archived):
            at = self._find(short)
            held = read_json(at / "chunks" / "manifest.json")
            out.append({"name": read_json(at / "topic.json").get("name", short), "slug": short, "archived": at.parent.name == "_archive", "chunks": held.get("n", 0), "version": held.get("version", 0)})
        return out

    def library(self, topics: list[str] | None = None, archived: bool = False) -> Library:
        """The current versions of all topics as one table, or of those that are named (put away or not)."""
        chunks, edges = self.spark.createDataFrame([], CHUNKS), self.spark.createDataFrame([], graph.EDGES)
        for short in self.names(archived) if topics is None else [slug(t) for t in topics]:
            at = self._find(short)
            for part, known in (("chunks", chunks), ("edges", edges)):
                table = store.VersionedTable(self.spark, str(at / part), self.embedder.name, self.embedder.dim)
                if table.manifest()["version"]:
                    rows = known.unionByName(table.read())
                    chunks, edges = (rows, edges) if part == "chunks" else (chunks, rows)
        return Library(self.spark, chunks, edges, self.embedder)

    def questions(self, texts: list[str]) -> DataFrame:
        return self.library([]).questions(texts)

    def ask(self, question: str | DataFrame, k: int = 5, topics: list[str] | None = None, archived: bool = False, **how):
        """Hits over all topics, fused once."""
        held = self.library(topics, archived)
        if isinstance(question, DataFrame):
            return held.ask(question, k, archived=True, **how)
        if not question.strip() or k < 1:
            return Result(question)
        return Result.of(question, held.ask(held.questions([question]), k, archived=True, **how))

    def __getitem__(self, name: str) -> Topic:
        self._find(name)
        return self.topic(name)

    def __contains__(self, name: str) -> bool:
        return bool(re.search("[0-9a-z]", name.lower())) and (self._dir(name).is_dir() or self._dir(name, True).is_dir())

    def __len__(self) -> int:
        return len(self.names())

    def __repr__(self) -> str:
        rows = [f"  {t['slug']:<24} {t['chunks']:>6} chunks{'  (archived)' if t['archived'] else ''}" for t in self.catalog(True)]
        return "\n".join([f"library({self.path}): {len(self)} topics, {len(self.sessions())} sessions", *rows])

    def close(self) -> None:
        for at in [p for p in _OPEN if p.is_relative_to(self.path)]:
            _OPEN[at].close()

    def __enter__(self) -> Home:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def library(spark: SparkSession, path: str | Path, embedder: Embedder | None = None) -> Home:
    """Open a library's folder, or create it."""
    return Home(spark, path, embedder or hashed())
