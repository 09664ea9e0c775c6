"""Vector functions as column expressions; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine; 0.0 if a norm is zero, or an error for that and for unequal lengths if strict."""
    size = norm(a) * norm(b)
    out = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    if strict:
        bad = (F.size(a) != F.size(b)) | (size == 0)
        return F.when(bad, F.raise_error(F.lit("vectors of unequal length or of norm zero")).cast("double")).otherwise(out)
    return out


def clamp01(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
