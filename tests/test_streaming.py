import json

from quillmark.sources import files
from quillmark.streaming import spool


def test_spool_drains_in_order_and_skips_poison(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    entry = lambda path, text: json.dumps({"op": "file", "path": path, "chunks": [{"id": f"{path}#0", "text": text, "meta": "{}"}]})
    (folder / "1.json").write_text(entry("a.md", "old") + "\n" + entry("b.md", "b") + "\nnot json\n")
    (folder / "2.json").write_text(entry("a.md", "new") + "\n" + json.dumps({"op": "remove", "path": "b.md"}) + "\n" + json.dumps({"op": "dance", "path": "c"}) + "\n")
    state = {"table": spark.createDataFrame([], "path string, id string, text string, meta string"), "bad": 0}

    def apply(batch, number):
        batch.persist()
        state["bad"] += spool.poison(batch).count()
        rows = spool.applied(state["table"], batch).collect()
        state["table"] = spark.createDataFrame(rows, state["table"].schema)
        batch.unpersist()

    spool.drain(spool.spool_stream(spark, str(folder)), str(tmp_path / "state"), apply)
    assert [tuple(r)[:3] for r in state["table"].collect()] == [("a.md", "a.md#0", "new")]
    assert state["bad"] == 2
    spool.drain(spool.spool_stream(spark, str(folder)), str(tmp_path / "state"), apply)  # nothing new
    assert state["bad"] == 2


def test_notes_are_parsed(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "People").mkdir(parents=True)
    (vault / ".obs").mkdir()
    (vault / "People" / "Alice.md").write_bytes(b"---\r\ntitle: Alice Example\r\ntags: [person, colleague]\r\n---\r\nHello #met\r\n")
    (vault / "Plain.md").write_text("# Heading\n\nbody")
    (vault / ".obs" / "x.md").write_text("hidden")
    (vault / "bad.md").write_bytes(b"\xff\xfe")
    found = {r.path: r for r in files.vault_notes(spark, str(vault)).collect()}
    assert sorted(found) == ["People/Alice.md", "Plain.md"]
    alice = found["People/Alice.md"]
    assert (alice.title, alice.kind, alice.tags, alice.text) == ("Alice Example", "People", ["person", "colleague", "met"], "Hello #met")
    assert (found["Plain.md"].title, found["Plain.md"].kind) == ("Heading", "root")
    docs = files.text_folder(spark, str(vault))
    assert sorted(r.doc for r in docs.collect()) == ["People/Alice.md", "Plain.md"]
