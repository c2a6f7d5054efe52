"""Vector expressions. Elements are added up as doubles whatever their type."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def mean_pool(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of those of an array of vectors whose mask is 1; zeros where the mask is empty."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dim), lambda s, z: F.zip_with(s, z["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))
