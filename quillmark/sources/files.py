"""Document sources: text folders, vault notes, mappings; and the JSON row format of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import auto_name, body, coerce_tags, frontmatter, inline_tags, note_kind, note_title, unix_lines

SUFFIXES = "*.{md,txt,rst,markdown}"


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``doc, text`` of the text files below a folder; hidden files and folders are left out, names are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(path)
    root = path.removeprefix("file://").rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), root, -1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(rel.alias("doc"), text.alias("text")).where(~F.col("doc").rlike(r"(^|/)\.") & F.col("text").isNotNull())


def vault_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a vault with title, kind, tags and body; files that are no UTF-8 are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    root = path.removeprefix("file://").rstrip("/") + "/"
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    raw = valid.select(F.substring_index("path", root, -1).alias("path"), F.col("content").cast("string").alias("raw"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"))
    return parsed_notes(raw.where(~F.col("path").rlike(r"(^|/)\.")))


def yaml_value(block: Column, key: str) -> Column:
    """A top-level scalar or flow list of a YAML block as text."""
    value = F.regexp_extract(block, rf"(?md)^{key}:[ \t]*(.*)$", 1)
    return F.trim(F.regexp_replace(value, r"^[\"'\[]+|[\"'\]]+$", ""))


def yaml_list(block: Column, key: str) -> Column:
    """A YAML list in flow or block style, comma separated."""
    lines = F.regexp_extract(block, rf"(?md)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1)
    items = F.array_join(F.transform(F.regexp_extract_all(lines, F.lit(r"-[ \t]+(.*)"), F.lit(1)), lambda x: F.trim(x)), ",")
    return F.coalesce(F.nullif(items, F.lit("")), yaml_value(block, key))


def parsed_notes(raw: DataFrame) -> DataFrame:
    """``path, raw, mtime`` -> ``path, title, kind, tags, mtime, source, text``."""
    clean = raw.withColumn("raw", unix_lines(F.col("raw")))
    block, text = frontmatter(F.col("raw")), F.regexp_replace(body(F.col("raw")), r"(?U)\A\s+|\s+\z", "")
    tags = F.array_distinct(F.concat(coerce_tags(yaml_list(block, "tags")), inline_tags(text)))
    source = F.when(F.col("path").startswith("inbox/"), "inbox").otherwise("vault")
    return clean.select("path", note_title(yaml_value(block, "title"), text, F.col("path")).alias("title"), note_kind(F.col("path")).alias("kind"), tags.alias("tags"), "mtime", source.alias("source"), text.alias("text"))


def from_mapping(spark: SparkSession, docs: dict[str, str]) -> DataFrame:
    """``doc, text`` of a mapping; blank texts are an error."""
    if blank := [name for name, text in docs.items() if not text or not text.strip()]:
        raise ValueError(f"no text in {blank}")
    return spark.createDataFrame(list(docs.items()), "doc string, text string")


def from_text(spark: SparkSession, text: str, name: str | None = None) -> DataFrame:
    """One document; without a name it gets one from its content."""
    rows = spark.createDataFrame([(name, text)], "doc string, text string")
    return rows.withColumn("doc", F.coalesce("doc", auto_name(F.col("text"))))


def item_json(items: DataFrame) -> DataFrame:
    """Rows as JSON lines; ``deleted`` appears only where true."""
    fields = [F.when(F.col(c), True).alias(c) if c == "deleted" else F.col(c) for c in items.columns]
    return items.select(F.to_json(F.struct(*fields)).alias("value"))
