"""Topics, conversations, vaults and the tool server on disk."""

import io
import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import models
from quillmark.operators import enrich, observe, store
from quillmark.plans.home import Home, documents, library, topic
from quillmark.plans.library import Library, Tools, schemas
from quillmark.plans.results import evaluate
from quillmark.plans.server import serve
from quillmark.plans.vault import Vault
from quillmark.sources.config import Settings
from quillmark.streaming import spool

DIM = models.hashed(32)


def test_topics_on_disk(spark, tmp_path):
    home = library(spark, tmp_path / "lib", DIM)
    webs = home.topic("Web Servers")
    assert home.topic("web servers") is webs and "WEB servers!" in home and "..." not in home
    assert webs.add({"a.md": "nginx listens on port 80", "b.md": "see [[a.md]] for tls"}).to_dict() == {"added": 2, "updated": 0, "skipped": 0, "removed": 0}
    assert not webs.add({"a.md": "nginx listens on port 80"}) and webs.add({"a.md": "nginx listens on port 8080"}).updated == 1
    assert webs.docs() == ["a.md", "b.md"] and "a.md" in webs and "c.md" not in webs and len(webs) == 2
    found = webs.ask("nginx listens on port 8080", k=1)
    assert found and found.top["doc"] == "a.md" and found.top["cos"] > 0.99 and len(found) == 1 and [h["doc"] for h in found] == ["a.md"] and found.ms > 0
    assert found.to_dict()["hits"][0]["via"] == "both" and "a.md" in found.context() and "1 hits" in repr(found)
    assert not webs.ask(" ") and not webs.ask("nginx", k=0)
    assert webs.keyword_index() is not None and webs.keyword_index()[0].where("term = '8080'").count() == 1
    assert [tuple(r)[:3] for r in webs.edges().collect()] == [("b.md", "a.md", "links")] and webs.linked_pairs() == 1
    key = webs.state_key()
    assert webs.update_text("web-servers/b.md#0", "tls is at port 443") and not webs.update_text("nope", "x") and webs.state_key() != key
    webs.link("a.md", "b.md", "near")
    assert webs.unlink("a.md", "b.md") and not webs.unlink("a.md", "b.md")
    with pytest.raises(store.StoreError, match="another writer"):
        type(webs)(spark, webs.path, "again", DIM)
    webs.close()
    with topic(spark, webs.path, embedder=DIM) as again:
        assert again.name == "Web Servers" and again.docs() == ["a.md", "b.md"] and again.ask("port 443", k=1).top["doc"] == "b.md"
        assert again.forget("b.md") == 1 and again.forget("b.md") == 0 and again.stats()["docs"] == 1
    with pytest.raises(store.StoreError, match="dimension"):
        topic(spark, webs.path, embedder=models.hashed(16))
    home.topic("Cooking").add("salt the water")
    assert home.names() == ["cooking", "web-servers"] and len(home) == 2
    home.archive("Cooking")
    assert home.names() == ["web-servers"] and "cooking" in home and home["cooking"].path.parent.name == "_archive"
    assert [t["chunks"] for t in home.catalog(True)] == [1, 1] and "(archived)" in repr(home)
    assert not home.ask("salt the water", k=1, min_score=0.9, mode="dense") and home.ask("salt the water", k=1, topics=["cooking"]).top["topic"] == "cooking"
    home.restore("cooking")
    home.delete("cooking")
    with pytest.raises(KeyError, match="web-servers"):
        home["cooking"]
    home.close()


def test_sources_of_documents(spark, tmp_path):
    (tmp_path / "n.md").write_text("one")
    assert [tuple(r) for r in documents(spark, tmp_path / "n.md").collect()] == [("n.md", "one")]
    assert documents(spark, str(tmp_path)).count() == 1 and documents(spark, [tmp_path / "n.md", "some text"]).count() == 2
    with pytest.raises(TypeError):
        documents(spark, 7)


def test_conversations(spark, tmp_path):
    home = Home(spark, tmp_path / "lib", DIM)
    with home.session("Refactor") as s:
        assert s.turn("user", "the flaky test shared a folder") == "00001-user" and s.turn("assistant", "each test has its own now", mood="glad") == "00002-assistant"
        assert s.history(1) == [("assistant", "each test has its own now")] and len(s) == 2 and list(s)[0][0] == "user"
        assert s.transcript() == "user: the flaky test shared a folder\nassistant: each test has its own now"
        assert s.recall("the flaky test shared a folder", k=1).top["doc"] == "00001-user"
        row = s.topic.library.live(archived=True).where("doc = '00002-assistant'").first()
        assert json.loads(row.meta)["mood"] == "glad" and json.loads(row.meta)["turn"] == "2"
        assert s.summary(lambda prompt: str("flaky" in prompt)) == "True"
    assert home.sessions() == ["Refactor"] and home.names() == [] and not home.ask("flaky test", k=3)


def test_enrichment(spark):
    said = '{"entities": ["Redis", "redis", "Kafka"], "relations": [["Redis", "Feeds Into", "Kafka"]]}'
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        return said if "Redis" in prompt else "nothing"

    reply = models.chat(model)
    docs = lambda *rows: spark.createDataFrame(rows, "doc string, text string")
    lib = Library(spark, embedder=DIM).add("t", docs(("a", "Redis talks to Kafka"), ("b", "plain words")), reply)
    assert [tuple(r) for r in lib.entities().collect()] == [("Kafka", 1), ("Redis", 1)]
    edges = sorted(tuple(r)[:3] for r in lib.edges.collect())
    assert edges == [("Redis", "Kafka", "feeds_into"), ("a", "Kafka", "mentions"), ("a", "Redis", "mentions")]
    assert lib.ask(lib.questions(["Redis talks to Kafka"]), 5, entity="REDIS", min_score=0.0).count() == 1
    same = lib.add("t", docs(("a", "Redis talks to Kafka")))
    assert same.entities().count() == 2  # an unchanged text keeps its entities
    changed = lib.add("t", docs(("a", "all is new here")))
    assert changed.entities().count() == 0 and changed.edges.count() == 0


def test_vault(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "People").mkdir(parents=True)
    (root / "People" / "Ann.md").write_text("---\ntags: [friend]\n---\nAnn likes [[Boats]] #sea")
    (root / "Boats.md").write_text("# Boats\n\nall about boats")
    vault = Vault(spark, Settings(vault=str(root), home=str(tmp_path / "home")), DIM)
    assert vault.sync() == {"added": 2} and vault.sync() == {"skipped": 2}
    assert vault.search("# Boats\n\nall about boats", 1).top["path"] == "Boats.md"
    assert vault.search("boats", 5, kinds=["People"]).hits[0]["kind"] == "People"
    assert vault.get("Boats.md")["title"] == "Boats" and "all about" in vault.get("Boats.md")["text"]
    assert [n["path"] for n in vault.by_tag(["#sea"])] == ["People/Ann.md"] and vault.by_tag([" "]) == []
    assert [n["path"] for n in vault.recent(5, "People")] == ["People/Ann.md"] and len(vault.recent(5)) == 2
    assert vault.related("People/Ann.md", 2)[0] == {"path": "Boats.md", "title": "Boats", "kind": "root", "score": pytest.approx(0.4, abs=0.61), "via": "graph"}
    path = vault.remember("buy rope", ("todo",), "Rope")
    assert vault.search("buy rope", 1).top["path"] == path
    entry = lambda op, path, *texts: {"op": op, "path": path, "chunks": [{"id": f"{path}#{k}", "text": t, "meta": json.dumps({"title": "T", "kind": "root"})} for k, t in enumerate(texts)]}
    folder = vault.settings.spool_dir
    assert spool.write(folder, []) is None
    first = spool.write(folder, [entry("file", "new.md", "first text", "second text"), {"op": "dance", "path": "x"}])
    second = spool.write(folder, [entry("file", "new.md", "only text"), {"op": "remove", "path": "Boats.md"}])
    assert first.name < second.name and vault.stats()["pending"] == 2
    assert vault.drain() == {"files": 2, "applied": 3, "skipped": 1}
    assert vault.search("only text", 1).top["id"] == "new.md#0" and vault.rows.where("path in ('new.md', 'Boats.md')").count() == 1
    assert len(list(folder.glob("*.done"))) == 2 and spool.swept(folder, 0.0, now=9e9) == 2
    again = Vault(spark, vault.settings, DIM)
    assert again.rows.count() == vault.rows.count() and spool.ids_by_path(again.rows).where("path = 'new.md'").first()["ids"] == ["new.md#0"]


def test_a_failing_drain_leaves_its_file(spark, tmp_path):
    broken = models.Embedder("hashed:32", 32, lambda text: F.raise_error(F.lit("the server is down")).cast("array<double>"))
    vault = Vault(spark, Settings(vault=str(tmp_path), home=str(tmp_path / "home")), broken)
    spool.write(vault.settings.spool_dir, [{"op": "file", "path": "a.md", "chunks": [{"id": "a.md#0", "text": "t", "meta": "{}"}]}])
    assert vault.drain()["files"] == 0 and vault.stats()["pending"] == 1 and vault.stats()["observed"]["embed_errors_1h"] == 1
    vault.embedder = DIM
    assert vault.drain()["files"] == 1 and vault.stats()["pending"] == 0


def test_tool_server(spark):
    tools = Tools(Library(spark, embedder=DIM), reply=lambda prompt: "It is salt [1].")
    sink = io.StringIO()
    call = lambda n, tool, **args: {"id": n, "method": "tools/call", "params": {"name": tool, "arguments": args}}
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call(3, "remember", text="salt the water", topic="Cooking", name="w"),
             call(4, "recall", query="salt the water", topic="COOKING", k="1"), call(5, "recall", query="x", topic="nope"), call(6, "answer", query="salt the water"), {"id": 7, "method": "no"}]
    serve(tools, io.StringIO("\n".join(json.dumps(m) for m in asked) + "\n\nnot json\n[]\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [m["id"] for m in got] == [1, 2, 3, 4, 5, 6, 7, None, None] and len(got[1]["result"]["tools"]) == 5
    assert json.loads(got[3]["result"]["content"][0]["text"])["hits"][0]["doc"] == "w"
    assert got[4]["result"]["isError"] and "cooking" in got[4]["result"]["content"][0]["text"] and "[1]" in got[5]["result"]["content"][0]["text"] and "error" in got[6]
    assert schemas("function")[0]["function"]["parameters"]["required"] == ["query"] and schemas()[0]["input_schema"]["type"] == "object"


def test_chat_server_and_cross_encoder(spark):
    server = models.ChatServer("m", system="be brief", post=lambda url, body, timeout: {"message": {"content": body["messages"][-1]["content"].upper()}}, lines=lambda *_: iter([{"message": {"content": "a"}}, {"message": {"content": "b"}, "done": True}, {"message": {"content": "c"}}]))
    assert server.reply("hi") == "HI" and "".join(server.tokens("hi")) == "ab"
    with pytest.raises(models.ModelError):
        models.ChatServer("m", post=lambda *_: {}).reply("hi")

    def load():
        class Model:
            def predict(self, pairs):
                return [float(q == t) for q, t in pairs]

        return Model()

    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "q string, t string")
    assert [r[0] for r in rows.select(models.cross_encoder(load)(F.col("q"), F.col("t"))).collect()] == [1.0, 0.0]


def test_evaluation_and_observation(spark):
    lib = Library(spark, embedder=DIM).add("t", spark.createDataFrame([("a", "apples are red"), ("b", "pears are green")], "doc string, text string"))
    report = evaluate(lib, [("apples are red", "APPLES"), ("pears are green", "b"), ("apples are red", "nothing of the kind")], k=1)
    assert report.to_dict() == {"label": "", "n": 3, "hit1": 0.667, "hitk": 0.667, "mrr": 0.667}
    seen = observe.Observed()
    with pytest.raises(ValueError), seen.call("ask", "chat"):
        raise ValueError("no")
    seen.took("ask", 250.0)
    assert seen.stats()["counters"] == {"ask": 1} and seen.stats()["chat_errors_1h"] == 1 and seen.stats()["slow"][-1]["ms"] == 250.0
    calls = spark.createDataFrame([(float(x),) for x in range(1, 101)], "ms double")
    assert tuple(observe.latencies(calls).first()) == (100, 50.5, 95.05)
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, rank long, id long")
    assert observe.recall_at(hits.where("id <> 2"), hits, 2).first()["recall"] == 0.5
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as ts from range(10)")
    assert observe.counted_within(events, 120.0, F.lit("2024-01-01 00:05:00").cast("timestamp")).first()["n"] == 2
    assert spark.range(1).select(observe.age_seconds(F.lit(10.0), F.lit(25.0)).alias("a")).first()["a"] == 15.0


def test_store_checks_rows(spark):
    held = spark.createDataFrame([("a", "old", "h", '{"entities":"[]","x":"1"}', 0.0, False, None)], "id string, text string, hash string, meta string, ts double, deleted boolean, embedding array<double>")
    rows = lambda *r: spark.createDataFrame(r, "id string, text string, meta string")
    got = store.merged(held, rows(("n", "x", None), ("n", "y", None)).coalesce(1))
    assert sorted((r.id, r.text) for r in got.collect()) == [("a", "old"), ("n", "y")]
    assert store.actions(held, rows(("n", "x", None), ("n", "y", None))).count() == 1
    for bad in (("", "x", None), (None, "x", None), ("k", None, None)):
        with pytest.raises(Exception, match="an item needs"):
            store.merged(held, rows(bad)).collect()
    assert json.loads(held.select(store.meta_with(F.col("meta"), "y", F.lit("2")).alias("m")).first()["m"]) == {"entities": "[]", "x": "1", "y": "2"}
