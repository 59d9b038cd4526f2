"""Vector functions as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """-1 for null, empty, unequally long or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fine & (norm > 0), dot(a, b) / norm).otherwise(-1.0)


def blended(exact: Column, semantic: Column, lexical: Column) -> Column:
    """1 for an exact match, else 0.85 of the positive cosine and 0.15 of the lexical overlap; the latter alone without a cosine."""
    return F.when(exact, 1.0).when(semantic.isNull(), lexical).otherwise(0.85 * F.greatest(F.lit(0.0), semantic) + 0.15 * lexical)
