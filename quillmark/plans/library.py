"""Topics in one table: add, forget, ask, route, relate, answer, and the JSON verbs for agents."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.models import Embedder, chat, hashed, reranker
from quillmark.operators import chunk, duplicates, enrich, graph, keyword, retrieve, sessions, store

CHUNKS = "id string, topic string, doc string, idx long, heading string, text string, hash string, meta string, ts double, deleted boolean, archived boolean, embedding array<double>"


def slug(name: str) -> str:
    found = re.sub(r"[^0-9a-z_.-]+", "-", name.strip().lower()).strip("-_.")
    if not found:
        raise ValueError("a topic's name needs a letter or digit")
    return found


@dataclass
class Library:
    """Chunks of all topics as one DataFrame. Verbs return a new library or a DataFrame; nothing is changed in place."""

    spark: SparkSession
    chunks: DataFrame | None = None
    edges: DataFrame | None = None
    embedder: Embedder = field(default_factory=hashed)
    chunk_words: int = 120
    overlap: int = 20

    def __post_init__(self) -> None:
        self.chunks = self.spark.createDataFrame([], CHUNKS) if self.chunks is None else self.chunks
        self.edges = self.spark.createDataFrame([], graph.EDGES) if self.edges is None else self.edges

    def _with(self, chunks: DataFrame | None = None, edges: DataFrame | None = None) -> Library:
        return Library(self.spark, self.chunks if chunks is None else chunks, self.edges if edges is None else edges, self.embedder, self.chunk_words, self.overlap)

    # --- changes ---

    def add(self, topic: str, docs: DataFrame, reply: Callable[[Column], Column] | None = None) -> Library:
        """Documents ``doc, text`` chunked and merged: unchanged chunks keep their vectors and entities, vanished ones get tombstones.

        What vanished or changed chunks said leaves the graph. With ``reply``, a model's answers to prompts, entities
        and relations of new chunks are found and linked.
        """
        name = slug(topic)
        parts = chunk.chunk_text(docs, self.chunk_words, self.overlap)
        key = F.concat(F.lit(name + "/"), T.chunk_id(F.col("doc"), F.col("idx")))
        new = parts.select(key.alias("id"), "doc", "idx", "heading", "text", F.lit(None).cast("string").alias("meta"))
        mine = self.chunks.where(F.col("topic") == name)
        places = new.select("id", F.col("doc").alias("d"), F.col("idx").alias("i"), F.col("heading").alias("h"))
        merged = store.merged(mine, new, self.embedder.apply).join(places, "id", "left")
        merged = merged.withColumns({"topic": F.lit(name), "doc": F.coalesce("d", "doc"), "idx": F.coalesce("i", "idx"), "heading": F.coalesce("h", "heading"), "archived": F.coalesce("archived", F.lit(False))})
        gone = store.stale(mine, new).select("id")
        rows = store.removed(merged.select(self.chunks.columns), gone)
        before = mine.where("not deleted").select("id", F.col("hash").alias("before"))
        changed = before.join(rows.where("not deleted").select("id", "hash"), "id", "left").where("hash is null or hash <> before").select(F.col("id").alias("source"))
        edges = self.edges
        if reply is not None:
            found = enrich.extracted(rows, reply)
            rows = enrich.with_entities(rows, found)
            edges = graph.link(edges, enrich.relations(found))
        whole = self.chunks.where(F.col("topic") != name).unionByName(rows)
        return self._with(whole, graph.link(enrich.pruned(edges, whole, changed), graph.link_edges(docs)))

    def forget(self, topic: str, doc: str) -> Library:
        mine = (F.col("topic") == slug(topic)) & (F.col("doc") == doc)
        return self._with(self.chunks.withColumn("deleted", F.col("deleted") | mine), graph.drop_node(self.edges, doc))

    def archive(self, topic: str, on: bool = True) -> Library:
        return self._with(self.chunks.withColumn("archived", F.when(F.col("topic") == slug(topic), on).otherwise(F.col("archived"))))

    def delete(self, topic: str) -> Library:
        return self._with(self.chunks.where(F.col("topic") != slug(topic)))

    # --- reading ---

    def live(self, topics: list[str] | None = None, archived: bool = False) -> DataFrame:
        rows = self.chunks.where("not deleted")
        if topics is not None:
            return rows.where(F.col("topic").isin([slug(t) for t in topics]))
        return rows if archived else rows.where("not archived")

    def catalog(self) -> DataFrame:
        return self.live(archived=True).groupBy("topic", "archived").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("chunks")).orderBy("topic")

    def questions(self, texts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(k, t) for k, t in enumerate(texts) if t and t.strip()], "query_id long, text string")
        return rows.withColumn("qv", self.embedder.apply(F.col("text")))

    def ask(
        self, queries: DataFrame, k: int = 5, mode: str = "hybrid", topics: list[str] | None = None, min_score: float = 0.3, entity: str | Column | None = None,
        route: bool = False, rerank=None, margin: float | None = None, archived: bool = False, index: tuple[DataFrame, DataFrame] | None = None,
    ) -> DataFrame:
        """``query_id, rank, id, topic, doc, text, cos, fused, via`` of the k best chunks for each query.

        Keyword statistics are each topic's own, scores are scaled over the union of all candidates: the best of every
        topic and leg. With ``route`` a query sees only the topics nearest to it. ``entity`` keeps hits that name it.
        With a reranker only contested pools are scored again, if a margin is given. ``index`` is a stored keyword
        index of just these chunks. k below 1, no queries and no chunks give no rows.
        """
        rows = self.live(topics, archived)
        k = max(0, int(k))
        numbered = rows.withColumn("key", F.xxhash64("id")).select(F.col("key").alias("id"), "topic", "text", "embedding")
        pool = retrieve.pool_size(k)
        posts, sizes = index or (numbered, keyword.topic_sizes(numbered))
        words = keyword.bm25_best(posts, sizes, queries, pool, per_topic=True)
        kept = None
        if route:
            near = retrieve.route(queries.select("query_id", "qv"), retrieve.centroids(rows)).where("chosen").select("query_id", "topic")
            kept = lambda leg: leg.join(near, ["query_id", "topic"], "left_semi")
        fused = retrieve.fused(retrieve.pooled(queries, numbered, words, pool, min_score, per_topic=True, kept=kept), mode)
        held = rows.select(F.xxhash64("id").alias("key"), F.col("id").alias("name"), "topic", "doc", "text", "meta")
        found = fused.join(held, fused.id == held.key).drop("id", "key").withColumnRenamed("name", "id")
        if entity is not None:
            found = found.where(enrich.has_entity(F.col("meta"), entity) if isinstance(entity, str) else entity)
        score = reranker(rerank)
        if score is None:
            return keyword.best(found, "fused", k)
        ranked = keyword.best(found, "fused", pool).join(queries.select("query_id", F.col("text").alias("q")), "query_id")
        if margin is None:
            return retrieve.rerank(ranked, k, score(F.col("q"), F.col("text")))
        flags = ranked.join(retrieve.should_rerank(ranked, margin), "query_id")
        again = retrieve.rerank(flags.where("contested"), k, score(F.col("q"), F.col("text")))
        return flags.where(~F.col("contested") & (F.col("rank") <= k)).unionByName(again, allowMissingColumns=True)

    def route(self, queries: DataFrame, **how) -> DataFrame:
        return retrieve.route(queries.select("query_id", "qv"), retrieve.centroids(self.live()), **how)

    def related(self, topic: str, k: int = 5, alpha: float = 0.6) -> DataFrame:
        """For every document its first chunk's neighbours blended with the graph."""
        rows = self.live([topic]).withColumn("key", F.xxhash64("id"))
        first = rows.groupBy("doc").agg(F.min_by("key", "idx").alias("query_id"), F.min_by("embedding", "idx").alias("qv"))
        near = retrieve.dense_topk(first.select("query_id", "qv"), rows.select(F.col("key").alias("id"), "embedding"), retrieve.pool_size(k), exclude_self=True)
        pairs = near.join(first.select("query_id", "doc"), "query_id").join(rows.select(F.col("key").alias("id"), F.col("doc").alias("other")), "id")
        docs = rows.select("doc").distinct()
        direct = graph.both_ways(self.edges).select(F.col("at").alias("doc"), "other", "weight").join(docs, "doc").join(docs.withColumnRenamed("doc", "other"), "other").select("doc", "other", "weight")
        return graph.related(pairs.select("doc", "other", "cos"), direct.unionByName(graph.bridges(self.edges, docs).select("doc", "other", "weight")), k, alpha)

    def duplicates(self, threshold: float = 0.95, topics: list[str] | None = None) -> DataFrame:
        """``id, cluster, size`` of live chunks whose vectors are that close to another's."""
        rows = self.live(topics, archived=True).withColumn("key", F.xxhash64("id"))
        found = duplicates.clusters(rows.select(F.col("key").alias("id"), "embedding"), threshold)
        names = rows.select("key", F.col("id").alias("name"))
        heads = names.select(F.col("key").alias("cluster"), F.col("name").alias("head"))
        return found.join(names, found.id == names.key).join(heads, "cluster").select(F.col("name").alias("id"), F.col("head").alias("cluster"), "size")

    def entities(self, topics: list[str] | None = None) -> DataFrame:
        return enrich.entity_counts(self.live(topics, archived=True))

    def has_doc(self, topic: str, doc: str) -> bool:
        return not self.live([topic]).where(F.col("doc") == doc).isEmpty()

    def neighbours(self, starts: list[str], **how) -> DataFrame:
        return graph.neighbours(self.edges, self.spark.createDataFrame([(s,) for s in starts], "start string"), **how)

    def link(self, src: str, dst: str, relation: str = "related", weight: float = 1.0) -> Library:
        new = self.spark.createDataFrame([(src, dst, relation, weight, None)], graph.EDGES)
        return self._with(edges=graph.link(self.edges, new))

    def unlink(self, src: str, dst: str, relation: str | None = None) -> Library:
        return self._with(edges=graph.unlink(self.edges, src, dst, relation))

    def answer(self, queries: DataFrame, reply: Callable[[str], str], k: int = 4, refuse_below: float | None = None, max_words: int = 600, **how) -> DataFrame:
        """``query_id, answer, cited, refused``: grounded replies with checked citations; refused ones ask no model."""
        hits = self.ask(queries, k, **how)
        block = sessions.context(hits.withColumn("score", F.col("cos")), max_words)
        count = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("cos"))).alias("top"))
        rows = queries.select("query_id", F.col("text").alias("question")).join(block, "query_id", "left").join(count, "query_id", "left")
        rows = rows.withColumn("refused", F.col("top").isNull() | (F.lit(False) if refuse_below is None else F.col("top") < refuse_below))
        prompt = F.concat(F.lit("Answer from the numbered sources only and cite them.\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
        said = rows.where("not refused").withColumn("raw", chat(reply)(prompt))
        done = said.select("query_id", T.citations_checked(F.col("raw"), F.col("n")).alias("answer"), T.cited(F.col("raw"), F.col("n")).alias("cited"), "refused")
        none = rows.where("refused").select("query_id", F.lit(None).cast("string").alias("answer"), F.array().cast("array<bigint>").alias("cited"), "refused")
        return done.unionByName(none)


TOOLS = {
    "recall": ("Find what was kept about a question.", {"query": str, "topic": str, "k": int}, ("query",)),
    "remember": ("Keep a text in a topic.", {"text": str, "topic": str, "name": str}, ("text", "topic")),
    "forget": ("Drop a document of a topic.", {"topic": str, "doc": str}, ("topic", "doc")),
    "topics": ("List the topics with their numbers of documents.", {}, ()),
    "answer": ("Answer a question from what was kept, with sources.", {"query": str, "topic": str, "k": int}, ("query",)),
}
_KINDS = {str: "string", int: "integer"}


def schemas(shape: str = "input") -> list[dict]:
    """The tools' JSON schemas: with ``input_schema``, or (``function``) wrapped as functions with ``parameters``."""
    out = []
    for name, (about, fields, needed) in TOOLS.items():
        schema = {"type": "object", "properties": {f: {"type": _KINDS[t]} for f, t in fields.items()}, "required": list(needed), "additionalProperties": False}
        if shape == "function":
            out.append({"type": "function", "function": {"name": name, "description": about, "parameters": schema}})
        else:
            out.append({"name": name, "description": about, "input_schema": schema})
    return out


class Tools:
    """JSON verbs over a library, for an agent: bounded answers, errors that name what is wrong."""

    def __init__(self, library: Library, reply: Callable[[str], str] | None = None):
        self.library, self.reply = library, reply

    def dispatch(self, name: str, args: dict | None = None) -> dict:
        args = args or {}
        if name not in TOOLS:
            raise KeyError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
        _, fields, needed = TOOLS[name]
        if missing := [a for a in needed if a not in args]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        if unknown := [a for a in args if a not in fields]:
            raise ValueError(f"{name} has no argument {', '.join(unknown)}")
        args = {a: self._k(v) if a == "k" else v for a, v in args.items()}
        if wrong := [a for a, v in args.items() if not isinstance(v, fields[a])]:
            raise ValueError(f"{name} has arguments of the wrong kind: {', '.join(wrong)}")
        return getattr(self, f"_{name}")(**args)

    @staticmethod
    def _k(value) -> int:
        """A number of hits, from 1 to 50; whole numbers in other dress are taken as such."""
        if isinstance(value, bool) or not re.fullmatch(r"\s*-?\d+(\.0*)?\s*", str(value)):
            raise ValueError(f"k must be a whole number, not {value!r}")
        return min(max(1, int(float(value))), 50)

    def _topic(self, name: str) -> str:
        """A topic by any spelling of its name."""
        known = {r["topic"]: r["archived"] for r in self.library.catalog().collect()}
        if (found := slug(name)) not in known:
            raise KeyError(f"no topic {name!r}; there are {', '.join(sorted(known)) or 'none'}")
        return found

    def _recall(self, query: str, topic: str | None = None, k: int = 5) -> dict:
        found = self.library.ask(self.library.questions([query]), k, topics=[self._topic(topic)] if topic else None)
        rows = found.orderBy("rank").select("id", "topic", "doc", "text", F.round("cos", 4).alias("score"), "via").collect()
        return {"hits": [r.asDict() for r in rows]}

    def _answer(self, query: str, topic: str | None = None, k: int = 4) -> dict:
        if self.reply is None:
            raise ValueError("answer needs a chat model")
        row = self.library.answer(self.library.questions([query]), self.reply, k, topics=[self._topic(topic)] if topic else None).first()
        return {"answer": row["answer"], "cited": row["cited"], "refused": row["refused"]} if row else {"answer": None, "cited": [], "refused": True}

    def _remember(self, text: str, topic: str, name: str | None = None) -> dict:
        from quillmark.sources.files import from_text

        self.library = self.library.add(topic, from_text(self.library.spark, text, name))
        return {"topic": slug(topic)}

    def _forget(self, topic: str, doc: str) -> dict:
        self.library = self.library.forget(self._topic(topic), doc)
        return {"topic": slug(topic), "doc": doc}

    def _topics(self) -> dict:
        return {"topics": [json.loads(r[0]) for r in self.library.catalog().select(F.to_json(F.struct("topic", "archived", "docs", "chunks"))).collect()]}
