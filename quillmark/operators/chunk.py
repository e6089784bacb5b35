"""Chunkers as array expressions: heading sections, greedy packing, overlap, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import H2, HEADING, word_count, words

_HEAD = r"(?md)\A(#{1,6}[ \t]+\S.*)$"


def sections(text: Column) -> Column:
    """``array<struct<heading, body>>``: split at headings; a blank preamble goes."""
    parts = F.filter(F.split(text, HEADING), lambda p: F.trim(F.regexp_replace(p, r"\s+", "")) != "")
    head = lambda p: F.regexp_extract(p, _HEAD, 1)
    return F.transform(parts, lambda p: F.struct(F.nullif(F.trim(head(p)), F.lit("")).alias("heading"), F.substring(p, F.length(head(p)) + 1, F.length(p)).alias("body")))


def paragraphs(body: Column) -> Column:
    """Blank-line separated paragraphs, trimmed."""
    edge = r"(?U)\A\s+|\s+\z"
    return F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, edge, "")), lambda p: p != "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs: it travels in an array of one."""
    return F.transform(F.array(value), use)[0]


def packed(paras: Column, max_words: int, min_words: int) -> Column:
    """Paragraphs packed greedily into pieces of max_words; a last piece below min_words joins the one before."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, p: Column) -> Column:
        full = (F.size(s["buf"]) > 0) & (s["n"] + p["n"] > max_words)
        out = F.when(full, F.concat(s["out"], F.array(F.array_join(s["buf"], "\n\n")))).otherwise(s["out"])
        buf = F.when(full, F.array(p["p"])).otherwise(F.concat(s["buf"], F.array(p["p"])))
        return F.struct(out.alias("out"), buf.alias("buf"), F.when(full, p["n"]).otherwise(s["n"] + p["n"]).alias("n"))

    def end(s: Column) -> Column:
        rest = F.array_join(s["buf"], "\n\n")
        glued = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.concat(F.element_at(s["out"], -1), F.lit("\n\n"), rest)))
        return F.when(F.size(s["buf"]) == 0, s["out"]).when((F.size(s["out"]) > 0) & (s["n"] < min_words), glued).otherwise(F.concat(s["out"], F.array(rest)))

    counted = F.transform(paras, lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))
    return F.aggregate(counted, start, add, end)


def last_words(text: Column, n: int) -> Column:
    return once(words(text), lambda w: F.array_join(F.slice(w, -F.least(F.lit(n), F.size(w)), F.lit(n)), " ")) if n else F.lit("")


def chunk_text(docs: DataFrame, max_words: int = 120, overlap: int = 20, min_words: int | None = None) -> DataFrame:
    """``docs(doc, text)`` -> ``doc, idx, heading, text``: sections packed, with the heading and the overlap in front."""
    least = max(1, max_words // 6) if min_words is None else min_words
    parts = docs.select("doc", F.posexplode(sections(F.col("text"))).alias("s", "part"))
    pieces = parts.withColumn("pieces", packed(paragraphs(F.col("part.body")), max_words, least))
    pieces = pieces.where((F.size("pieces") > 0) | F.col("part.heading").isNotNull())
    pieces = pieces.withColumn("pieces", F.when(F.size("pieces") == 0, F.array(F.lit(""))).otherwise(F.col("pieces")))

    def full(piece: Column, i: Column) -> Column:
        lead = once(last_words(F.get("pieces", i - 1), overlap), lambda before: F.when((i > 0) & (before != ""), F.concat(F.lit("… "), before)))
        return F.array_join(F.array_compact(F.array(F.col("part.heading"), lead, F.nullif(piece, F.lit("")))), "\n\n")

    made = pieces.select("doc", "s", F.col("part.heading").alias("heading"), F.posexplode(F.transform("pieces", full)).alias("i", "text"))
    grouped = made.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "i", "heading", "text"))).alias("c"))  # one document's chunks
    return grouped.select("doc", F.posexplode("c").alias("idx", "c")).select("doc", F.col("idx").cast("long").alias("idx"), "c.heading", "c.text")


def chunk_paragraphs(docs: DataFrame, max_words: int = 120, min_words: int = 20) -> DataFrame:
    """``docs(doc, text)`` -> ``doc, idx, text``: packing alone, without headings and overlap. No shuffle."""
    made = docs.select("doc", F.posexplode(packed(paragraphs(F.col("text")), max_words, min_words)).alias("idx", "text"))
    return made.withColumn("idx", F.col("idx").cast("long"))


def windows(text: Column, window: int = 400, overlap: int = 50) -> Column:
    """Sliding windows of words, cut from the original text so that inner white space stays."""
    step = max(1, window - overlap)

    def cut(tokens: Column) -> Column:
        last = F.ceil(F.greatest(F.size(tokens) - window, F.lit(0)) / step).cast("int")
        one = lambda i: F.regexp_replace(F.array_join(F.slice(tokens, i * step + 1, F.lit(window)), ""), r"(?U)\A\s+", "")
        return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), one))

    return once(F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0)), cut)  # each word with the white space in front of it


def vault_chunks(notes: DataFrame, max_tokens: int = 800, window: int = 400, overlap: int = 50) -> DataFrame:
    """``notes(path, text)`` -> ``path, section_idx, heading, text``: whole, else second-level sections, else windows."""
    strip = lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", "")
    parts = F.filter(F.transform(F.split("text", H2), strip), lambda p: p != "")
    has_h2 = F.col("text").rlike(r"(?md)^## ")
    short = ~F.exists(parts, lambda p: word_count(p) > max_tokens)
    cut = lambda h, t: F.struct(h.alias("heading"), t.alias("text"))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit(0).alias("section_idx"), none.alias("heading"), F.col("text").alias("text")))
    numbered = lambda a: F.transform(a, lambda x, i: F.struct((i + 1).alias("section_idx"), x["heading"].alias("heading"), x["text"].alias("text")))
    by_h2 = numbered(F.transform(parts, lambda p: cut(F.nullif(F.trim(F.regexp_extract(p, r"(?md)\A## +(.*)$", 1)), F.lit("")), p)))
    by_window = numbered(F.transform(windows(F.col("text"), window, overlap), lambda w: cut(none, w)))
    chosen = F.when(word_count(F.col("text")) <= max_tokens, whole).when(has_h2 & short, by_h2).otherwise(by_window)
    return notes.select("path", F.explode(chosen).alias("c")).select("path", F.col("c.section_idx").cast("long").alias("section_idx"), "c.heading", "c.text")
