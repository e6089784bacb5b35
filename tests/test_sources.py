import pytest

from quillmark.sources import config, files, notes


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('vault = "/v"\nflush_changes = "7"\n')
    found = config.load(tmp_path / "c.toml", embedder="hashed:8", home=None)
    assert (found.vault, found.flush_changes, found.embedder, found.home) == ("/v", 7, "hashed:8", "~/.quillmark")
    assert config.flush_due(found, 7, 0.0) and not config.flush_due(found, 3, 1.0) and config.flush_due(found, 1, 31.0) and not config.flush_due(found, 0, 99.0, True)
    (tmp_path / "c.toml").write_text("nope = 1\n")
    with pytest.raises(ValueError, match="nope"):
        config.load(tmp_path / "c.toml")


def test_notes_go_to_the_inbox(spark, tmp_path):
    path = notes.remember(tmp_path, "buy milk today", ("#shopping",), "Buy: milk")
    assert path.startswith("inbox/") and "buy-milk" in path and "buy milk today" in notes.get(tmp_path, path)
    row = files.vault_notes(spark, str(tmp_path)).first()
    assert (row.path, row.title, row.tags, row.source) == (path, "Buy: milk", ["shopping"], "inbox")
    for bad in ("../x.md", "/etc/passwd"):
        with pytest.raises(ValueError):
            notes.get(tmp_path, bad)


def test_sources_of_texts(spark):
    assert files.from_text(spark, "abc").first()["doc"].startswith("note-")
    with pytest.raises(ValueError):
        files.from_mapping(spark, {"a": " "})
    items = spark.createDataFrame([("a", False), ("b", True)], "id string, deleted boolean")
    assert sorted(r.value for r in files.item_json(items).collect()) == ['{"id":"a"}', '{"id":"b","deleted":true}']
