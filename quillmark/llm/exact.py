"""Exact deduplication against a persistent digest index that is bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, only_rows, row_hash, shared_dir

SCHEMA = "text_sha256 string, keep_id long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, row_hash, text_sha256``: SHA-256 of the whole text in UTF-8, unchanged; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


class DigestIndex:
    """One row per distinct text ever seen: its digest, the doc_id that stays and the size of its group.

    The table is bucketed and sorted by digest, so that checking new data against it is a sort-merge anti-join
    that only shuffles the new digests, and never the index. Appends add sorted files to the buckets. A digest
    that two writers or a repeated run put in twice counts once.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark, self.name = spark, name or f"quillmark_digests_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            place = path or f"{shared_dir(spark)}/quillmark/{self.name}"
            spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {count} BUCKETS LOCATION '{place}'")
        facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        self.buckets, self.path = int(facts["Num Buckets"]), facts["Location"]

    def rows(self) -> DataFrame:
        """The index; no shuffle, as equal digests are in one bucket."""
        return self.spark.table(self.name).groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index doesn't hold yet."""
        return groups.hint("merge").join(self.spark.table(self.name).select("text_sha256"), "text_sha256", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add the groups that are new; a digest that is held already stays as it is."""
        fresh = self.unseen(groups.select("text_sha256", "keep_id", "group_size"))
        fresh.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        Scratch(self.spark).drop(self.path)


def groups_of(marked: DataFrame) -> DataFrame:
    """One row per distinct digest. Partial aggregation comes first, so a text with any number of copies is cheap."""
    head = F.coalesce(F.max_by("row_hash", "doc_id"), F.max("row_hash"))  # rows without an id that share a text share their hash
    return marked.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), head.alias("row_hash"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Of equal texts the row with the largest doc_id stays; null and empty texts are equal. With an ``index``, a
    text that it already holds stays with the earlier ``keep_id`` and the new copies all go; texts that are new
    are appended. Without one, an index is built for this call and dropped again. Rows that repeat a doc_id and
    its text are all marked alike; rows that repeat a doc_id with different texts are judged each by its own. A
    null doc_id loses to any other and is kept only if its whole group has none. An empty table gives no rows.
    Other columns are ignored.
    """
    marked = digests(docs)
    held = index or DigestIndex(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        groups = scratch.write(groups_of(marked), "groups")
        held.append(groups)
        verdicts = scratch.write(groups.select("text_sha256", "group_size").join(held.rows().drop("group_size"), "text_sha256"), "verdicts", keep=True)
    if index is None:
        held.drop()
    # Both sides of this join are dealt out by digest, so that a group of any size can be split over tasks.
    both = marked.join(verdicts, "text_sha256")
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_of_each_text(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs``, all columns: one row of each distinct text, the one with the largest doc_id.

    Null and empty texts are equal. Rows are told apart by id and text, so ids may repeat and be null; of rows that
    are repeated whole one stays. With an ``index``, texts that it holds go, and new ones are appended.
    """
    held = index or DigestIndex(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        groups = scratch.write(groups_of(digests(docs)), "groups")
        heads = scratch.write(held.unseen(groups).select(F.col("keep_id").alias("doc_id"), "row_hash"), "heads", keep=True)
        held.append(groups)
    if index is None:
        held.drop()
    return only_rows(docs, heads)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)
"""
