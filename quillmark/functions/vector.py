"""Vector expressions over ARRAY columns; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    length = norm(v)
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    """A deterministic stand-in for a model: bytes of a SHA-256 chain over the text, scaled and of unit length."""
    blocks = -(-dim // 32)
    chain = F.aggregate(
        F.sequence(F.lit(1), F.lit(blocks)),
        F.struct(F.sha2(text.cast("binary"), 256).alias("last"), F.lit("").alias("all")),
        lambda s, i: F.struct(F.sha2(F.unhex(s["last"]), 256).alias("last"), F.concat(s["all"], s["last"]).alias("all")),
        lambda s: s["all"],
    )
    pairs = F.slice(F.regexp_extract_all(chain, F.lit(".."), F.lit(0)), 1, dim)
    values = F.transform(pairs, lambda h: (F.conv(h, 16, 10).cast("double") - 127.5) / 127.5)
    # the sum of squares travels with the values, so that nothing is computed once an element
    both = F.array(values)
    return F.flatten(F.transform(both, unit))
