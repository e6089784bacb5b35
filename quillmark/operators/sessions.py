"""Conversation turns and context blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import words


def numbered(turns: DataFrame) -> DataFrame:
    """``session, turn, role, text`` with ``name``: turns numbered from 1 in each session."""
    order = Window.partitionBy("session").orderBy("turn")
    n = F.row_number().over(order)
    return turns.withColumns({"n": n.cast("long"), "name": F.concat(F.lpad(n.cast("string"), 5, "0"), F.lit("-"), F.col("role"))})


def history(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each session (0: all)."""
    if not n:
        return turns
    back = Window.partitionBy("session").orderBy(F.col("turn").desc())
    return turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n).drop("back")


def transcript(turns: DataFrame, n: int = 0) -> DataFrame:
    """``session, transcript``: a line a turn, oldest first."""
    lines = history(turns, n).select("session", F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")).alias("x"))
    return lines.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n").alias("transcript"))  # one session's text


def context(hits: DataFrame, max_words: int = 600) -> DataFrame:
    """``query_id, rank, doc, score, text`` -> ``query_id, context``: numbered blocks within a budget of words.

    Blocks are taken in rank order while the budget lasts; the one that passes it is cut, headers don't count.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counted = hits.withColumn("w", words(F.col("text"))).withColumn("used", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)))
    kept = counted.where(F.col("used") < max_words).withColumn("room", max_words - F.col("used"))
    body = F.when(F.size("w") <= F.col("room"), F.col("text")).otherwise(F.concat(F.array_join(F.slice("w", F.lit(1), F.col("room").cast("int")), " "), F.lit(" …")))
    block = F.concat(F.format_string("[%d] (%s, score %.2f)\n", "rank", "doc", "score"), body)
    return kept.select("query_id", F.struct("rank", block.alias("block")).alias("x")).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["block"], "\n\n").alias("context"))
