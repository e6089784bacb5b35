import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_optional_package(tmp_path):
    shutil.copytree(ROOT / "quillmark", tmp_path / "quillmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_broken_optional_package_is_told(tmp_path):
    shutil.copytree(ROOT / "quillmark", tmp_path / "quillmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode and "no_such_module" in run.stderr


@pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")
@pytest.mark.parametrize("name", ["dense_min_score", "bm25_topk_per_topic", "hybrid_rrf", "upsert_merge", "stale_rows", "context_block", "entity_bridges", "citation_filter", "slugify", "text_update", "mention_edges", "chunk_headings_overlap", "spool_batch", "note_frontmatter", "bfs_neighbours"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(repr([list(x) if hasattr(x, "__iter__") and not isinstance(x, str) else x.item() if hasattr(x, "item") else x for x in row]) for row in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)
