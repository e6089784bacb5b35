"""Further queries with DuckDB SQL beside each: rows of a store, edges of a graph, text and number functions, changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import vector as V
from quillmark.operators import enrich, graph, keyword, observe, sessions, store
from quillmark.plans.storage import shared_dir
from quillmark.queries import _E, _bm25, _edges, _hits, _old_and_new, _OLD, one_topic, query, questions, r6, table, texts
from quillmark.sources import files
from quillmark.streaming import spool

_TURNS = "SELECT conv_id AS session, turn, role, text FROM conversations"


def _held(spark, d):
    """Rows of a store with tombstones on every id that ends in 1."""
    old, _ = _old_and_new(spark, d)
    return store.removed(old, old.where("cast(id as long) % 10 = 1").select("id"))


# --- rows of a store ---------------------------------------------------------------------------


@query(f"WITH o AS ({_OLD}) SELECT doc_id::VARCHAR AS id FROM o WHERE doc_id % 10 <> 1")
def live_rows(spark, d):
    return _held(spark, d).where("not deleted").select("id")


@query(f"WITH o AS ({_OLD}) SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 <> 1 AND doc_id % 4 = 0 THEN 'm' || doc_id ELSE 'old' END AS meta FROM o")
def metadata_replace(spark, d):
    held = _held(spark, d)
    new = texts(spark, d).where("id % 4 = 0").select(F.col("id").cast("string").alias("id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("meta"))
    return store.with_meta(held, new).select("id", "meta")


@query(f"WITH o AS ({_OLD}) SELECT doc_id::VARCHAR AS id, left(sha1(CASE WHEN doc_id % 10 <> 1 AND doc_id % 4 = 0 THEN text || ' again' ELSE text END), 16) AS hash, 'old' AS meta, doc_id % 10 = 1 AS deleted FROM o")
def text_update(spark, d):
    """New texts of live rows; metadata stays, unknown ids and tombstones change nothing."""
    new = texts(spark, d).where("id % 4 = 0").select(F.col("id").cast("string").alias("id"), F.concat("text", F.lit(" again")).alias("text"))
    return store.updated_texts(_held(spark, d), new).select("id", "hash", "meta", "deleted")


@query(f"WITH o AS ({_OLD}) SELECT doc_id::VARCHAR AS id FROM o WHERE doc_id % 4 <> 1")
def compaction(spark, d):
    """A quarter of the rows are tombstones: more than a fifth, so they go."""
    old, _ = _old_and_new(spark, d)
    return store.compacted(store.removed(old, old.where("cast(id as long) % 4 = 1").select("id"))).select("id")


@query("SELECT doc_id AS id, to_json({'x': doc_id::VARCHAR, 'y': 'new'}) AS meta FROM documents")
def metadata_merge(spark, d):
    rows = texts(spark, d).select("id", F.to_json(F.create_map(F.lit("x"), F.col("id").cast("string"), F.lit("y"), F.lit("old"))).alias("meta"))
    return rows.select("id", store.meta_with(F.col("meta"), "y", F.lit("new")).alias("meta"))


@query("SELECT lang AS doc, count(*) AS chunks FROM documents GROUP BY 1")
def doc_list(spark, d):
    return texts(spark, d, "lang").groupBy(F.col("topic").alias("doc")).agg(F.count("*").alias("chunks"))


@query("SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'fr')")
def tag_filter(spark, d):
    tags = F.array("lang", "source")
    return table(spark, d, "documents").where(T.has_any_tag(tags, ["#en", " ", "fr "])).select(F.col("doc_id").alias("id"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY coalesce(nullif(epoch(ts), 0), 0) DESC, event_id) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events)) WHERE n <= 20")
def recent_of_a_kind(spark, d):
    """The latest rows of one kind: by the file's time where there is one, else by that of indexing."""
    rows = table(spark, d, "events").withColumn("when", F.coalesce(F.nullif(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(0.0)), F.lit(0.0)))
    kind = rows.agg(F.min("event_type").alias("event_type"))
    return rows.join(F.broadcast(kind), "event_type").orderBy(F.desc("when"), "event_id").limit(20).select("event_id")


@query("""SELECT entity, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS entity FROM documents) GROUP BY 1""")
def entities_of_chunks(spark, d):
    """Entities kept in the metadata, counted by chunk."""
    named = F.to_json(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0))))
    rows = texts(spark, d).select("id", F.lit(False).alias("deleted"), store.meta_with(F.lit("{}"), "entities", named).alias("meta"))
    return enrich.entity_counts(rows)


@query("""SELECT src, dst, min(source) AS source FROM (SELECT DISTINCT lang AS src, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS dst, doc_id AS source FROM documents) GROUP BY 1, 2""")
def mention_edges(spark, d):
    named = F.to_json(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0))))
    rows = texts(spark, d, "lang").select("id", F.col("topic").alias("doc"), F.lit(False).alias("deleted"), store.meta_with(F.lit("{}"), "entities", named).alias("meta"))
    return enrich.mentions(rows).select("src", "dst", "source")


@query(f"""WITH {_bm25("source")}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, id) AS rank FROM bm) SELECT query_id, rank, id, round(bm, 6) AS score FROM ranked WHERE rank <= 5""")
def stored_keyword_index(spark, d):
    """A keyword index that is written, read again and asked: the texts are cut once for any number of questions."""
    where, chunks = f"{shared_dir(spark)}/quillmark/index-{uuid.uuid4().hex}", texts(spark, d)
    keyword.postings(chunks).write.parquet(f"{where}/postings")
    keyword.topic_sizes(chunks).write.parquet(f"{where}/sizes")
    return _hits(keyword.bm25_best(spark.read.parquet(f"{where}/postings"), spark.read.parquet(f"{where}/sizes"), questions(spark, d), 5), "bm")


# --- edges ---------------------------------------------------------------------------------------


def _new_edges(spark, d):
    return _edges(spark, d).where("relation = 'n'").withColumn("weight", F.lit(2.0))


_SHOW = ("src", "dst", "relation", "weight")


@query(f"WITH {_E} SELECT src, dst, relation, round(CASE WHEN relation = 'n' THEN 2.0 ELSE weight END, 6) AS weight FROM e")
def edge_upsert(spark, d):
    return graph.link(_edges(spark, d), _new_edges(spark, d)).select(*_SHOW[:3], r6(F.col("weight")).alias("weight"))


@query(f"WITH {_E} SELECT src, dst, relation FROM e WHERE NOT (src = 's1' AND relation = 'a') AND src <> 's2' AND dst <> 'p3'")
def edge_deletes(spark, d):
    """All edges of one relation that leave a node, then two nodes with all that is incident to them."""
    return graph.drop_node(graph.drop_node(graph.unlink_all(_edges(spark, d), "s1", "a"), "s2"), "p3").select(*_SHOW[:3])


@query(f"WITH {_E} SELECT src, dst, relation FROM e WHERE substr(dst, 2)::BIGINT % 7 <> 0")
def edges_without_sources(spark, d):
    """Edges that didn't come from chunks which are gone."""
    edges = _edges(spark, d).withColumn("source", F.col("dst"))
    gone = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("source"))
    return graph.drop_sources(edges, gone).select(*_SHOW[:3])


@query(f"WITH {_E} SELECT count(*) AS pairs, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes FROM (SELECT DISTINCT src, dst FROM e)")
def graph_size(spark, d):
    rows = table(spark, d, "lineitem")
    ends = rows.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return graph.size(ends, 8 * rows.rdd.getNumPartitions())


# --- notes ---------------------------------------------------------------------------------------

_NOTE = "'---' || chr(10) || 'title: T' || doc_id || chr(10) || 'tags: [a, #b]' || chr(10) || '---' || chr(10) || '# Head ' || doc_id || chr(10) || text || ' [[' || source || '|x]] #tag' || (doc_id % 5)"


def _note(spark, d):
    head = F.concat(F.lit("---\ntitle: T"), F.col("id"), F.lit("\ntags: [a, #b]\n---\n# Head "), F.col("id"), F.lit("\n"), "text", F.lit(" [["), "topic", F.lit("|x]] #tag"), (F.col("id") % 5).cast("string"))
    return texts(spark, d).select("id", head.alias("raw"))


@query(rf"""SELECT doc_id AS id, 'title: T' || doc_id || chr(10) || 'tags: [a, #b]' AS block, sha1('# Head ' || doc_id || chr(10) || text || ' [[' || source || '|x]] #tag' || (doc_id % 5)) AS body FROM documents""")
def note_frontmatter(spark, d):
    return _note(spark, d).select("id", T.frontmatter(F.col("raw")).alias("block"), F.sha1(T.body(F.col("raw")).cast("binary")).alias("body"))


@query(f"SELECT doc_id AS id, 'Head ' || doc_id AS title, 'tag' || (doc_id % 5) AS last_tag, source AS link FROM documents")
def note_parts(spark, d):
    """Title by its first heading, the last inline tag, the last link."""
    rows = _note(spark, d).withColumn("body", T.body(F.col("raw")))
    return rows.select("id", T.note_title(F.lit(None), F.col("body"), F.lit("x.md")).alias("title"), F.element_at(T.inline_tags(F.col("body")), -1).alias("last_tag"), F.element_at(T.wikilinks(F.col("body")), -1).alias("link"))


@query("SELECT doc_id AS id, 'note-' || left(sha1(text), 12) AS name, 'a' || doc_id || '/b.c' AS stem, source || '#' || doc_id AS chunk FROM documents")
def names(spark, d):
    path = F.concat(F.lit("x/a"), F.col("id"), F.lit("/"), F.lit("b.c.md"))
    stem = F.concat(F.lit("a"), F.col("id"), F.lit("/"), T.path_stem(path))
    return texts(spark, d).select("id", T.auto_name(F.col("text")).alias("name"), stem.alias("stem"), T.chunk_id(F.col("topic"), F.col("id")).alias("chunk"))


@query(r"""SELECT doc_id AS id, coalesce(nullif(trim(left(trim(regexp_replace(regexp_replace(lower(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:6], ' ')), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g')), 60)), ''), 'note') AS slug FROM documents""")
def note_slugs(spark, d):
    return texts(spark, d).select("id", T.note_slug(F.lit(None).cast("string"), F.col("text")).alias("slug"))


@query("SELECT doc_id AS id, sha1(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS h FROM documents")
def unix_newlines(spark, d):
    return texts(spark, d).select("id", F.sha1(T.unix_lines(F.regexp_replace("text", "\n", "\r\n")).cast("binary")).alias("h"))


@query("SELECT doc_id AS id, ['a', source, lang] AS tags FROM documents")
def tag_lists(spark, d):
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").alias("id"), T.coerce_tags(F.concat(F.lit("#a, ,"), "source", F.lit(" , ##"), "lang")).alias("tags"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'new ' || role ELSE 'old ' || role END AS question FROM conversations")
def rewritten_questions(spark, d):
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"new '), "role", F.lit('"\nand more'))).otherwise(F.lit('""'))
    return table(spark, d, "conversations").select("conv_id", "turn", T.rewritten(reply, F.concat(F.lit("old "), "role")).alias("question"))


@query("SELECT doc_id AS id, [source, 'Redis'] AS entities, [source || '|feeds_into|Redis'] AS relations FROM documents")
def extraction_parsing(spark, d):
    said = F.concat(F.lit('Well: {"entities": ["'), "topic", F.lit('", "Redis", "redis "], "relations": [["'), "topic", F.lit('", "Feeds Into", "Redis"], ["x"]]} so.'))
    return texts(spark, d).select("id", T.extraction(said).alias("x")).select("id", "x.entities", F.transform("x.relations", lambda r: F.concat_ws("|", r["s"], r["r"], r["o"])).alias("relations"))


# --- numbers, time, changes ---------------------------------------------------------------------


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round((embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))))::DOUBLE, 6) AS x FROM embeddings")
def unit_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), r6(V.norm(F.col("embedding"))).alias("norm"), r6(V.unit(F.col("embedding"))[0]).alias("x"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return observe.latencies(table(spark, d, "events").withColumn("ms", F.col("value").cast("double")), ("event_type",))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1")
def errors_of_the_last_hour(spark, d):
    rows = table(spark, d, "events")
    now = rows.agg(F.max("ts").alias("now"))
    return observe.counted_within(rows.join(F.broadcast(now)), 3600.0, F.col("now"), ("event_type",))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS second FROM events")
def time_stamps(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, d, "events").select("event_id", T.stamp(seconds, "compact").alias("compact"), T.stamp(seconds, "second").alias("second"))


@query(f"WITH t AS ({_TURNS}) SELECT count(DISTINCT session) AS sessions, count(*) AS turns FROM t")
def session_counts(spark, d):
    rows = sessions.history(table(spark, d, "conversations").withColumnRenamed("conv_id", "session"), 0)
    return rows.agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("turns"))


@query("""WITH t AS (SELECT doc_id AS id, lang || (doc_id % 100) AS path, text FROM documents),
e AS (SELECT path, max(id) AS last FROM t WHERE id % 3 = 0 GROUP BY 1)
SELECT path, id::VARCHAR AS id, sha1(text) AS h FROM t WHERE path NOT IN (SELECT path FROM e) UNION ALL SELECT e.path, t.id::VARCHAR, sha1(t.text || '!') FROM e JOIN t ON t.id = e.last WHERE e.last % 2 = 1""")
def spool_batch(spark, d):
    """A batch of changes over a table: of each path the last counts; odd ones replace its chunks, even ones remove them."""
    rows = texts(spark, d, "lang").select("id", F.concat("topic", (F.col("id") % 100).cast("string")).alias("path"), "text")
    held = rows.select("path", F.col("id").cast("string").alias("id"), "text", F.lit("{}").alias("meta"))
    chunks = F.array(F.struct(F.col("id").cast("string").alias("id"), F.concat("text", F.lit("!")).alias("text"), F.lit("{}").alias("meta")))
    op = F.when(F.col("id") % 2 == 1, "file").otherwise("remove")
    entries = rows.where("id % 3 = 0").select(op.alias("op"), "path", chunks.alias("chunks"), F.lit(None).cast("string").alias("_corrupt_record"), F.format_string("%09d", "id").alias("file"), F.lit(0).alias("at"))
    return spool.applied(held, entries).select("path", "id", F.sha1(F.col("text").cast("binary")).alias("h"))


@query("SELECT lang || (doc_id % 100) AS path, list_sort(list(doc_id::VARCHAR)) AS ids FROM documents GROUP BY 1")
def ids_by_path(spark, d):
    rows = texts(spark, d, "lang").select(F.concat("topic", (F.col("id") % 100).cast("string")).alias("path"), F.col("id").cast("string").alias("id"))
    return spool.ids_by_path(rows)


@query("SELECT doc_id AS id, sha1(json) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"deleted\":true}' ELSE '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' END AS json FROM documents)")
def json_rows(spark, d):
    rows = texts(spark, d, "lang").select("id", F.col("topic").alias("lang"), (F.col("id") % 2 == 0).alias("deleted"))
    lines = files.item_json(rows)
    return lines.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.sha1(F.col("value").cast("binary")).alias("h"))
