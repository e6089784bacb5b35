import pytest
from pyspark.sql import functions as F

from quillmark.functions.models import hashed
from quillmark.operators import chunk, duplicates, graph, keyword, retrieve, sessions, store
from quillmark.plans.library import Library, Tools


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_chunks_pack_overlap_and_glue(spark):
    para = "\n\n".join(" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    docs = spark.createDataFrame([("p", "# Top\n\n" + para), ("t", " ".join(["w"] * 100) + "\n\ntail"), ("h", "# Only"), ("e", "")], "doc string, text string")
    found = {(r.doc, r.idx): r.text for r in chunk.chunk_text(docs, 120, 10).collect()}
    assert [i for d, i in found if d == "p"] == [0, 1]
    assert found["p", 1].startswith("# Top\n\n… b40 b41")
    assert [d for d, _ in found].count("t") == 1 and found["h", 0] == "# Only"
    assert not any(d == "e" for d, _ in found)


def test_vault_windows(spark):
    notes = spark.createDataFrame([("a.md", " ".join(f"w{i}" for i in range(1000))), ("b.md", "short"), ("c.md", "x\n## One\n" + "y " * 500 + "\n## Two\n" + "z " * 500)], "path string, text string")
    found = chunk.vault_chunks(notes).orderBy("path", "section_idx").collect()
    assert [r.text.split()[0] for r in found if r.path == "a.md"] == ["w0", "w350", "w700"]
    assert [r.section_idx for r in found if r.path == "b.md"] == [0]
    assert [r.heading for r in found if r.path == "c.md"] == [None, "One", "Two"]


def test_clusters(spark):
    def v(**xs):
        return [float(xs.get(f"e{i}", 0)) for i in range(8)]

    unit = [v(e0=1), v(e0=1, e1=0.3), v(e0=1, e2=0.3), v(e4=1), v(e4=1, e6=0.45), v(e7=1)]
    unit = [[x / sum(y * y for y in u) ** 0.5 for x in u] for u in unit]
    table = spark.createDataFrame(list(enumerate(unit)), "id long, embedding array<double>")
    assert rows(duplicates.clusters(table, 0.95), "id", "cluster") == [(0, 0), (1, 0), (2, 0)]
    assert rows(duplicates.clusters(table, 0.90), "id", "cluster") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    assert rows(duplicates.clusters(table, 0.999), "id") == []
    with pytest.raises(ValueError):
        duplicates.clusters(table, 1.5)


def test_rrf_and_rerank_rule(spark):
    cands = spark.createDataFrame([(0, 1, 0.9, 1.0, True, True), (0, 2, 0.8, 0.0, True, False), (0, 3, 0.7, 2.0, True, True)], "query_id long, id long, cos double, bm double, in_dense boolean, in_kw boolean")
    got = {r.id: r.fused for r in retrieve.fused(cands, fusion="rrf").collect()}
    assert got[1] == pytest.approx(1 / 61 + 1 / 62) and got[3] == pytest.approx(1 / 63 + 1 / 61)
    for scores, margin, want in (([1, 0.5, 0], 0.25, False), ([1, 0.9, 0], 0.25, True), ([1, 0.5, 0], 0.51, True), ([1, 0.5, 0], 0.5, False), ([1, 1, 1], 0.25, True), ([0.5], 0.25, False)):
        hits = spark.createDataFrame([(0, k + 1, float(s)) for k, s in enumerate(scores)], "query_id long, rank long, fused double")
        assert retrieve.should_rerank(hits, margin).first()["contested"] is want


def test_dense_ties_at_the_cut(spark):
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, qv array<double>")
    assert rows(retrieve.dense_topk(asked, table, 3), "id") == [(0,), (1,), (2,)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "cites", 1.0, None), ("a", "b", "uses", 0.5, None), ("b", "c", "cites", 1.0, "s1")], graph.EDGES)
    start = spark.createDataFrame([("a",)], "start string")
    assert rows(graph.neighbours(edges, start), "node", "relation") == [("b", "cites"), ("b", "uses")]
    assert rows(graph.neighbours(edges, start, depth=2), "node", "hops") == [("b", 1), ("b", 1), ("c", 2)]
    out = spark.createDataFrame([("c",)], "start string")
    assert rows(graph.neighbours(edges, out, direction="out"), "node") == [] and rows(graph.neighbours(edges, out, direction="in"), "node") == [("b",)]
    assert graph.drop_sources(edges, spark.createDataFrame([("s1",)], "source string")).count() == 2
    with pytest.raises(Exception, match="itself"):
        graph.link(edges, spark.createDataFrame([("x", "x", "r", 1.0, None)], graph.EDGES)).collect()
    notes = spark.createDataFrame([("db.md", "uses [[pg]]"), ("run/pg.md", "[[db.md]]")], "doc string, text string")
    assert rows(graph.link_edges(notes), "src", "dst") == [("db.md", "run/pg.md"), ("run/pg.md", "db.md")]


def test_bridges_deal_out_no_pairs(spark):
    """30 documents on one node and an edge between two of them: 870 pairs, which no exchange or further join sees."""
    edges = spark.createDataFrame([(f"d{k}", "n", "r", 1.0, None) for k in range(29)] + [("n", "d29", "s", 0.5, None), ("d0", "d1", "r", 1.0, None)], graph.EDGES)
    found = graph.bridges(edges, spark.createDataFrame([(f"d{k}",) for k in range(30)], "doc string"))
    assert found.count() == 870 and rows(found.where("doc = 'd29' and other = 'd3'"), "relation", "weight") == [("s→n→r", 0.25)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1


def test_topic_paths_keep_what_related_can_keep(spark):
    """30 rows of a topic; all pairs and the few give the same blend, ids that come twice and nearest of other topics included."""
    table = [(i, "ab"[i % 2]) for i in range(60)] + [(8, "a"), (21, "a"), (None, "a"), (70, None)]
    left = spark.createDataFrame([(i, t) for i, t in table if i in (0, 7, 8, 20)], "doc long, topic string")
    right = spark.createDataFrame(table, "other long, topic string")
    near = spark.createDataFrame([(d, o, c) for d in (0, 7, 8) for o, c in ((2, 0.1), (3, 0.9), (9, 0.3), (d, 1.0))], "doc long, other long, cos double")
    every = left.join(right, "topic").where("doc <> other").select("doc", "other", F.lit(0.5).alias("weight"))
    few = graph.topic_paths(left, right, near, 5 + 4 + 1, 0.5)
    show = ("doc", "other", "related", "via", "rank")
    assert rows(graph.related(near, few), *show) == rows(graph.related(near, every), *show)
    assert few.count() < every.count() / 2


def test_size_counts_without_aggregating_splits(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", None), (None, "c"), ("c", None)], "src string, dst string")
    found = graph.size(edges, 3)
    assert rows(found, "pairs", "nodes") == [(4, 4)]
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    first = max(k for k, line in enumerate(plan) if "Repartition" in line or "Exchange" in line)
    assert not any("HashAggregate" in line for line in plan[first:])


def test_sessions_and_context(spark):
    turns = spark.createDataFrame([("s", 0, "user", "keep numpy"), ("s", 1, "assistant", "until 100k chunks")], "session string, turn long, role string, text string")
    assert rows(sessions.numbered(turns), "name") == [("00001-user",), ("00002-assistant",)]
    assert sessions.transcript(turns, 1).first()["transcript"] == "assistant: until 100k chunks"
    hits = spark.createDataFrame([(0, 1, "a.md", 1.0, "one two three"), (0, 2, "b.md", 0.5, "four five six"), (0, 3, "c.md", 0.4, "x")], "query_id long, rank long, doc string, score double, text string")
    assert sessions.context(hits, 4).first()["context"] == "[1] (a.md, score 1.00)\none two three\n\n[2] (b.md, score 0.50)\nfour …"


def test_versions_survive_a_crash(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "s"), dim=4)
    data = spark.createDataFrame([(str(i), i < 2) for i in range(5)], "id string, deleted boolean")
    assert table.commit(data) == 1 and table.read().count() == 3  # two of five: compacted
    (tmp_path / "s" / "v2").mkdir()  # a crash before the manifest was swapped
    assert table.read().count() == 3 and table.commit(data.limit(1)) == 2
    with pytest.raises(store.StoreError):
        store.VersionedTable(spark, str(tmp_path / "s"), dim=8).read()
    (tmp_path / "s" / ".lock").touch()  # left by a process that is gone
    assert table.commit(data) == 3 and sorted(p.name for p in (tmp_path / "s").glob("v*")) == ["v2", "v3"]
    with store.Lock(tmp_path / "s"), pytest.raises(store.StoreError, match="another writer"):
        table.commit(data)
    (tmp_path / "s" / "manifest.json").write_text('{"version": 3, "embedder": "hashed", "dim": 4, "n": 77, "ts": 0}')
    with pytest.raises(store.StoreError, match="77"):
        table.read()


def test_library_round(spark):
    docs = spark.createDataFrame([("a.md", "para one about nginx\n\npara two about tls\n\npara three about certbot")], "doc string, text string")
    lib = Library(spark, embedder=hashed(64), chunk_words=3, overlap=0).add("Web servers", docs)
    assert rows(lib.catalog(), "topic", "chunks") == [("web-servers", 3)]
    found = lib.ask(lib.questions(["para two about tls"]), k=1).first()
    assert found["id"] == "web-servers/a.md#1" and found["via"] == "both" and found["cos"] > 0.99
    less = lib.add("web servers", spark.createDataFrame([("a.md", "para one about nginx\n\nchanged")], "doc string, text string"))
    assert less.live().count() == 2 and less.forget("web-servers", "a.md").live().count() == 0
    told = lib.answer(lib.questions(["para two about tls"]), lambda prompt: "It is tls [1] [9].", k=1).first()
    assert told["cited"] == [1] and "[9]" not in told["answer"]
    tools = Tools(lib)
    assert tools.dispatch("recall", {"query": "para two about tls", "k": 1})["hits"][0]["id"] == "web-servers/a.md#1"
    with pytest.raises(ValueError, match="query"):
        tools.dispatch("recall", {})


def test_bm25_prefers_rare_terms(spark):
    texts = ["manifest is written last", "manifest.json is the atomic commit point", "tombstoned 20% of rows", "other words", "the manifest"]
    chunks = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "topic string, id long, text string")
    posts, sizes = keyword.postings(chunks), keyword.topic_sizes(chunks)

    def top(q):
        asked = spark.createDataFrame([(0, q)], "query_id long, text string")
        return [r.id for r in keyword.best(keyword.bm25(posts, sizes, asked), "bm", 3).orderBy("rank").collect()]

    assert top("which file is the atomic commit point")[0] == 1 and top("manifest") == [4, 0] and top("manifest.json") == [1] and top("zebra") == [] and top("tombstoned 20%")[0] == 2


def _by_hand(texts, asked, k, per_topic):
    """BM25 of ``texts(topic, id, text)``, row by row."""
    import math
    import re

    from quillmark.functions import text as T

    cut = lambda x: [t for t in re.findall(T.TERM, (x or "").lower()) if t not in T.STOP_WORDS]
    found = {}
    for topic in {t for t, _, _ in texts}:
        docs = [(i, cut(x)) for t, i, x in texts if t == topic]
        average = sum(len(ts) for _, ts in docs) / len(docs)
        for query, text in asked:
            for i, ts in docs:
                score = 0.0
                for term in set(cut(text)) & set(ts):
                    df, tf = sum(term in x for _, x in docs), ts.count(term)
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / average))
                if score:
                    found.setdefault((query, topic) if per_topic else query, []).append((-round(score, 9), i, topic))
    return sorted((key[0] if per_topic else key, t, i, n + 1, -s) for key, held in found.items() for n, (s, i, t) in enumerate(sorted(held)[:k]))


@pytest.mark.parametrize("small", [False, True])
def test_bm25_best_equals_brute_force(spark, monkeypatch, small):
    """From texts and from postings, whole and in blocks, with ties, blank and missing texts; no row is made for a term, a chunk and a query."""
    import random

    if small:
        for name, value in (("PAIRS", 24), ("WEIGHTS", 16), ("SCORES", 40), ("BUFFER", 25)):
            monkeypatch.setattr(keyword, name, value)
    dice = random.Random(5)
    word = lambda: dice.choice(["alpha", "beta", "gamma", "delta", "eps", "the", "v1.2", "20%", "zeta", "eta"])
    texts = [(f"t{k % 3}", k, " ".join(word() for _ in range(dice.randint(1, 9)))) for k in range(120)] + [("t0", 200, None), ("t0", 201, ""), ("t1", 202, "the"), ("t2", 203, "alpha beta"), ("t2", 204, "Alpha, BETA")]
    asked = [(q, " ".join(word() for _ in range(4))) for q in range(9)] + [(50, "unknown"), (51, None), (52, "the")]
    chunks, queries = spark.createDataFrame(texts, "topic string, id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    for per_topic in (False, True):
        want = _by_hand(texts, asked, 3, per_topic)
        for posts in (chunks, keyword.postings(chunks)):
            found = keyword.bm25_best(posts, keyword.topic_sizes(chunks), queries, 3, per_topic)
            assert rows(found, "query_id", "topic", "id", "rank", "bm") == [pytest.approx(x) for x in want]
            assert "Join" not in found._jdf.queryExecution().sparkPlan().toString()
    assert rows(keyword.bm25_best(chunks, keyword.topic_sizes(chunks), queries.where("query_id > 49"), 3), "id") == []
    assert rows(keyword.term_df(chunks), "topic", "term", "df") == rows(keyword.term_df(keyword.postings(chunks)), "topic", "term", "df")


def test_term_df_shuffles_counts_alone(spark):
    """A term counts once a chunk; of texts there is one exchange, of terms and partial counts, and no row for a chunk and a term crosses it."""
    chunks = spark.createDataFrame([("t", 1, "Pear pear apple"), ("t", 1, "pear"), ("u", 2, "the pear"), ("u", 3, None), ("u", 4, "")], "topic string, id long, text string")
    found = keyword.term_df(chunks)
    assert rows(found, "topic", "term", "df") == [("t", "apple", 1), ("t", "pear", 2), ("u", "pear", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(topic") == 1 and plan.count("Exchange") == 1 and "partial_count" in plan


@pytest.mark.parametrize("block", [4096, 2])
def test_pools_have_true_cosines_in_one_pass(spark, monkeypatch, block):
    """Rows that only the keyword leg found get their cosine from the pass that finds the nearest; vectors meet no join."""
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "TILE_CHUNKS", 4)
    chunks = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(30)] + [(99, [-1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [1.0, q / 2]) for q in range(5)], "query_id long, qv array<double>")
    words = spark.createDataFrame([(q, i, 1.0) for q in range(5) for i in (99, 3)] + [(0, 555, 1.0)], "query_id long, id long, bm double")
    found = retrieve.pooled(asked, chunks, words.where("id <> 555"), 2, 0.0)
    nearest = lambda q: sorted(range(30), key=lambda i: (-round(1 + q * i / 20, 9), i))[:2]
    want = sorted((q, i, round(-1.0 if i == 99 else 1 + q * i / 20, 9), i in nearest(q), i in (99, 3)) for q in range(5) for i in {99, 3, *nearest(q)})
    assert rows(found, "query_id", "id", "cos", "in_dense", "in_kw") == want
    assert "embedding" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_hits_are_not_shuffled(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string")
    hits = spark.createDataFrame([(q, q * 3 % 40, 1) for q in range(50)], "query_id long, id long, rank long")
    for held in (1 << 17, 7):
        monkeypatch.setattr(retrieve, "HITS", held)
        found = retrieve.with_texts(hits, chunks)
        assert rows(found, "query_id", "id", "text") == sorted((q, q * 3 % 40, f"text {q * 3 % 40}") for q in range(50))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_components_by_one_task_and_by_stars(spark, monkeypatch):
    from quillmark.operators import duplicates

    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 80), (80, 90), (5, 5)], "u long, v long")
    want = sorted([(k, 0) for k in range(31)] + [(80, 80), (90, 80)])
    assert rows(duplicates.components(edges), "node", "component") == want
    assert duplicates.components(edges.limit(0)).count() == 0
    monkeypatch.setattr(duplicates, "FEW_LINKS", 3)
    assert rows(duplicates.components(edges), "node", "component") == want
