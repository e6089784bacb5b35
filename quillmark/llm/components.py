"""Connected components by alternating large-star and small-star steps; all state stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # every edge points from the larger id to the smaller
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges(u, v)`` of long ids -> ``(node, component)``: the smallest id reachable from each node of an edge.

    Nulls and self-links are ignored; repeated links and no links at all are fine. Each round writes its edges
    to the shared folder; only a row count and a checksum reach the driver.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "cc")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = scratch.write(_star(_star(now, True), False), "cc")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
