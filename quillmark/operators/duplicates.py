"""Similar pairs by blocked matrix products, and clusters of near-duplicates as connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.retrieve import _matrix
from quillmark.plans.storage import materialized

#: Vectors that are held against the whole table at a time.
BLOCK = 2048
#: So many links are settled by one task (16 bytes each); more go through rounds of stars.
FEW_LINKS = 1 << 18


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``vectors(id, embedding)`` -> ``a, b, cos`` with a < b and cosine of at least the threshold.

    Rows are dealt to blocks of about BLOCK vectors; a task multiplies a block with a later or equal one. Every block
    travels to as many tasks as there are blocks, which all-pairs comparison needs; no pair leaves below the threshold.
    """
    least = min(threshold, 1 - 1e-6)
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = rows.withColumn("other", F.explode(others)).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})

    def run(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        ids, block, m = table.column("id").to_numpy(), table.column("block").to_numpy(), _matrix(table.column("embedding"))
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        scores = m[left] @ m[right].T
        i, j = np.nonzero(scores >= least)
        a, b = ids[left[i]], ids[right[j]]
        keep = a < b if p == q else a != b
        a, b, s = a[keep], b[keep], scores[i, j][keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cos": s})

    return dealt.groupBy("p", "q").applyInArrow(run, "a long, b long, cos double")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of a bounded number of links, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``node, component`` (the smallest id reachable), by alternating stars; no driver state.

    Once no more than ``FEW_LINKS`` are left, which is from the start for a small table, one task joins them.
    """
    now, seen = materialized(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= FEW_LINKS:
            return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, component long")
        if mark == seen:
            break
        seen, now = mark, materialized(_star(_star(now, True), False), "edges")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def clusters(vectors: DataFrame, threshold: float = 0.86) -> DataFrame:
    """``id, cluster, size`` of the vectors that are in a cluster of two or more."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    parts = components(similar_pairs(vectors, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    return parts.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster"), "size")
