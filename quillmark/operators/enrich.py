"""Enrichment: entities and relations that a model finds in chunks, kept in their metadata and as edges of the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import extraction
from quillmark.operators import graph
from quillmark.operators.store import meta_get, meta_with

ASK = "List the names (tools, people, files, places, products) in the text below and how they are related. Answer with one JSON object: entities, a list of names; relations, a list of [name, verb, name].\n\n"


def entities(meta: Column) -> Column:
    """The entities of a chunk, from its metadata."""
    return F.coalesce(F.from_json(meta_get(meta, "entities"), "array<string>"), F.array().cast("array<string>"))


def extracted(chunks: DataFrame, reply: Callable[[Column], Column]) -> DataFrame:
    """``id, doc, found`` of the live chunks that have no entities yet: one call of the model each."""
    todo = chunks.where(~F.col("deleted") & meta_get(F.col("meta"), "entities").isNull())
    return todo.select("id", "doc", extraction(reply(F.concat(F.lit(ASK), F.col("text")))).alias("found"))


def with_entities(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks with the names that were found in their metadata."""
    named = found.select("id", F.to_json("found.entities").alias("names"))
    joined = chunks.join(named, "id", "left")
    return joined.withColumn("meta", F.when(F.col("names").isNotNull(), meta_with(F.col("meta"), "entities", F.col("names"))).otherwise(F.col("meta"))).select(chunks.columns)


def mentions(chunks: DataFrame) -> DataFrame:
    """Edges document -> entity of all live chunks, one each, with a chunk as its source."""
    rows = chunks.where(~F.col("deleted")).select("doc", "id", F.explode(entities(F.col("meta"))).alias("dst")).where("doc <> dst")
    once = rows.groupBy("doc", "dst").agg(F.min("id").alias("source"))
    return once.select(F.col("doc").alias("src"), "dst", F.lit("mentions").alias("relation"), F.lit(1.0).alias("weight"), "source")


def relations(found: DataFrame) -> DataFrame:
    """Edges between entities, with the chunk that says so as their source."""
    rows = found.select("id", F.explode("found.relations").alias("r")).where("r.s <> r.o")
    once = rows.groupBy(F.col("r.s").alias("src"), F.col("r.o").alias("dst"), F.col("r.r").alias("relation")).agg(F.min("id").alias("source"))
    return once.select("src", "dst", "relation", F.lit(1.0).alias("weight"), "source")


def pruned(edges: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph after texts changed: what ``gone(source)`` said goes, and mentions are built anew from what is left."""
    kept = graph.drop_sources(edges.where("relation <> 'mentions'"), gone)
    return kept.unionByName(mentions(chunks))


def entity_counts(chunks: DataFrame) -> DataFrame:
    """``entity, n``: in how many live chunks each name is, however it is spelt; the most frequent first, then by name."""
    rows = chunks.where(~F.col("deleted")).select("id", F.explode(entities(F.col("meta"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), F.lower("entity"), "entity")


def has_entity(meta: Column, wanted: str) -> Column:
    """Chunks that name an entity, without regard to case."""
    return F.exists(entities(meta), lambda e: F.lower(e) == wanted.lower())
