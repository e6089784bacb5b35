import hashlib

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import models
from quillmark.functions import text as T
from quillmark.functions import vector as V


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_terms_keep_inner_marks(spark):
    text = "The manifest.json is the commit-point (v1.2), >20% tombstoned!"
    assert one(spark, T.terms(F.col("t")), t=text) == ["manifest.json", "commit-point", "v1.2", "20%", "tombstoned"]


def test_slugs(spark):
    assert one(spark, T.topic_slug(F.col("t")), t="  Cooking at home! ") == "cooking-at-home"
    assert one(spark, T.topic_slug(F.col("t")), t="--__..") is None
    assert one(spark, T.note_slug(F.lit(None).cast("string"), F.col("t")), t="One two three four five six seven") == "one-two-three-four-five-six"
    assert one(spark, T.note_slug(F.lit("???"), F.lit("")), t="x") == "note"


def test_links_tags_and_stems(spark):
    text = "see [[Alice#Top|her]] and [[Bob]] not \\[[Eve]] again [[Bob]]"
    assert one(spark, T.wikilinks(F.col("t")), t=text) == ["Alice", "Bob"]
    tags = "a #one/two b#no http://x/#no\n```\n#code\n```\n#end #one/two"
    assert one(spark, T.inline_tags(F.col("t")), t=tags) == ["one/two", "end"]
    assert one(spark, T.path_stem(F.col("t")), t="a/b.c/Long note.md") == "Long note"


def test_citations(spark):
    text = "It is manifest.json [1] and [3], not [9]. Also [1]."
    assert one(spark, T.cited(F.col("t"), F.lit(3)), t=text) == [1, 3]
    assert one(spark, T.citations_checked(F.col("t"), F.lit(3)), t=text) == "It is manifest.json [1] and [3], not. Also [1]."
    assert one(spark, T.cited(F.col("t"), F.lit(3)), t="[n2] [n 1]") == [2, 1]


def test_extraction_is_tolerant(spark):
    reply = 'Sure: {"entities": ["Postgres", "postgres", " "], "relations": [["a", "Depends On", "b"], ["x"]]} done'
    found = one(spark, T.extraction(F.col("t")), t=reply)
    assert found["entities"] == ["Postgres"]
    assert [tuple(r) for r in found["relations"]] == [("a", "depends_on", "b")]
    assert one(spark, T.extraction(F.col("t")), t="no json")["entities"] == []


def test_hashed_embedding_equals_plain_python(spark):
    got = one(spark, V.hashed_embedding(F.col("t"), 70), t="milch kaufen")
    block, raw = hashlib.sha256("milch kaufen".encode()).digest(), b""
    while len(raw) < 70:
        raw += block
        block = hashlib.sha256(block).digest()
    want = (np.frombuffer(raw[:70], np.uint8) - 127.5) / 127.5
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-12)


def test_unit_keeps_zero(spark):
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_http_embedder_checks_replies(spark):
    good = models.http("m", 2, post=lambda url, body, timeout: {"embeddings": [[3.0, 4.0] for _ in body["input"]]})
    assert one(spark, good.apply(F.col("t")), t="a") == [0.6, 0.8]
    try:
        models.checked([[1.0]], 2, 1)
    except models.ModelError:
        pass
    else:
        raise AssertionError("a missing vector went unnoticed")
