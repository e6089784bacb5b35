"""Text expressions: hashes, names, tokens, links, tags, citations. All are built-in expressions, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a an and are as at be by did do does for from has have how i in is it its no not of on or"
    " that the they this to was we were what when where which who will with you".split()
)
TERM = r"[0-9a-z]+(?:[-_.'][0-9a-z]+)*%?"
HEADING = r"(?md)(?=^#{1,6}[ \t]+\S)"
H2 = r"(?md)(?=^## )"
BLANKS = r"(?U)\s+"


def content_hash(text: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of a text's SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


def auto_name(text: Column) -> Column:
    """A name for a note that has none."""
    return F.concat(F.lit("note-"), content_hash(text, 12))


def topic_slug(name: Column) -> Column:
    """Lower case, runs of other characters to one dash, none at the ends; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"[^0-9a-z_.-]+", "-")
    return F.nullif(F.regexp_replace(bare, r"^[-_.]+|[-_.]+$", ""), F.lit(""))


def note_slug(title: Column, text: Column) -> Column:
    """A file name of at most 60 characters from the title, else from the text's first six words."""
    source = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.array_join(F.slice(words(text), 1, 6), " "))
    bare = F.regexp_replace(F.regexp_replace(F.lower(source), "[^0-9a-z]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 60), F.lit("")), F.lit("note"))


def words(text: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def terms(text: Column) -> Column:
    """Search terms: lower-cased, with inner marks (v1.2, don't, 20%) and without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] in order, each once; headings and aliases are cut off, escaped links don't count."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\\)\[\[([^\]\[|#]+)(?:#[^\]\[|]*)?(?:\|[^\]\[]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def inline_tags(text: Column) -> Column:
    """#tags outside of fenced code, each once."""
    plain = F.regexp_replace(text, r"(?s)```.*?(```|\z)", " ")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![#&/\w])#([a-zA-Z][-/\w]*)"), F.lit(1)))


def coerce_tags(tags: Column) -> Column:
    """A comma-separated list as tags, without # and blanks."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.regexp_replace(F.trim(t), "^#+", "")), lambda t: t != "")


#: A YAML block whose top level is a mapping: keys with values, nested or listed lines below them, comments.
_YAML = r"(?:(?:[A-Za-z_][^:\n]*:(?:[ \t][^\n]*)?|[ \t]+[^\n]*|-[ \t][^\n]*|#[^\n]*|[ \t]*)(?:\n|\z))*"


def _block(raw: Column) -> Column:
    """What is between the marks at the top of a note, if it is a YAML mapping; else the empty string."""
    found = F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    open_ = F.regexp_count(found, F.lit(r"(?m)^[^#\n]*:[ \t]*[\[{][^\]}\n]*$"))  # a list or mapping that isn't closed
    fine = found.rlike(rf"\A{_YAML}\z") & found.rlike(r"(?m)^[A-Za-z_][^:\n]*:") & (open_ == 0)
    return F.when(fine, found).otherwise(F.lit(""))


def frontmatter(raw: Column) -> Column:
    """The YAML block at the top of a note, or the empty string."""
    return _block(raw)


def body(raw: Column) -> Column:
    """A note without its YAML block; a block that isn't a mapping is part of the text."""
    return F.when(_block(raw) == "", raw).otherwise(F.regexp_replace(raw, r"(?s)\A---\n.*?\n---(?:\n|\z)", ""))


def stamp(seconds: Column, form: str = "second") -> Column:
    """A UTC time stamp: ``compact`` (20240131T235959), ``second`` (2024-01-31T23:59:59Z) or ``micro``, which sorts by time."""
    forms = {"compact": "yyyyMMdd'T'HHmmss", "second": "yyyy-MM-dd'T'HH:mm:ss'Z'", "micro": "yyyyMMdd'T'HHmmssSSSSSS"}
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("long")), forms[form])


def unix_lines(raw: Column) -> Column:
    return F.regexp_replace(raw, "\r\n?", "\n")


def path_stem(path: Column) -> Column:
    """A path's file name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def note_title(front_title: Column, text: Column, path: Column) -> Column:
    """The title from the YAML block, else the first top heading, else the file's name."""
    first = F.nullif(F.trim(F.regexp_extract(text, r"(?md)^# +(.+)$", 1)), F.lit(""))
    return F.coalesce(F.nullif(F.trim(front_title), F.lit("")), first, path_stem(path))


def note_kind(path: Column) -> Column:
    """The top folder, or root."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("root"))


def is_vault_note(path: Column) -> Column:
    """Markdown files below no hidden folder, climbing nowhere."""
    return path.endswith(".md") & ~path.rlike(r"(^|/)\.") & ~path.startswith("/")


def cited(text: Column, hits: Column) -> Column:
    """Numbers of [n] citations that exist, in order, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[n?\s*([0-9]+)\]"), F.lit(1)), lambda n: n.cast("long"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= hits)))


def citations_checked(text: Column, hits: Column) -> Column:
    """The text without citations of hits that don't exist; runs of blanks become one."""
    pieces = F.split(text, r"(?=\[n?\s*[0-9]+\])|(?<=\])")
    kept = F.filter(pieces, lambda p: ~p.rlike(r"^\[n?\s*[0-9]+\]$") | F.regexp_extract(p, r"(\d+)", 1).cast("long").between(F.lit(1), hits))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, ""), r"[ \t]+", " "), r" ([.,;:!?])", "$1"))


def rewritten(reply: Column, question: Column) -> Column:
    """The first line of a model's rewrite without quotes, or the question itself."""
    line = F.trim(F.regexp_replace(F.split_part(F.trim(reply), F.lit("\n"), F.lit(1)), "^[\"'`]+|[\"'`]+$", ""))
    return F.coalesce(F.nullif(line, F.lit("")), question)


def relation_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^0-9_a-z]+", "_")


EXTRACTION = "struct<entities:array<string>,relations:array<array<string>>>"


def extraction(reply: Column) -> Column:
    """Entities and relations from a model's reply; anything malformed gives none.

    Entities are deduplicated without regard to case, the first spelling stays. A relation needs three parts.
    """
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), EXTRACTION)
    named = F.filter(F.transform(F.coalesce(parsed["entities"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda e: e != "")
    once = F.aggregate(
        named,
        F.array().cast("array<string>"),
        lambda seen, e: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(e)), seen).otherwise(F.concat(seen, F.array(e))),
    )
    triples = F.filter(F.coalesce(parsed["relations"], F.array().cast("array<array<string>>")), lambda r: F.size(r) == 3)
    relations = F.transform(triples, lambda r: F.struct(r[0].alias("s"), relation_name(r[1]).alias("r"), r[2].alias("o")))
    return F.struct(once.alias("entities"), relations.alias("relations"))


def has_entity(entities: Column, wanted: str) -> Column:
    return F.coalesce(F.exists(entities, lambda e: F.lower(e) == wanted.lower()), F.lit(False))


def has_any_tag(tags: Column, wanted: list[str]) -> Column:
    """Any of the tags; none wanted gives no rows."""
    clean = [t for t in (w.strip().lstrip("#") for w in wanted) if t]
    return F.coalesce(F.arrays_overlap(tags, F.array(*(F.lit(t) for t in clean))), F.lit(False)) if clean else F.lit(False)


def chunk_id(doc: Column, idx: Column) -> Column:
    return F.concat(doc, F.lit("#"), idx.cast("string"))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that a text has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, terms(text))) / F.size(q))
