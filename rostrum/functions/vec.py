"""Vectors as arrays of numbers."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def l2_normalised(a) -> Column:
    """The vector over its length, which is taken as 1e-9 at least."""
    a = F.col(a) if isinstance(a, str) else a
    norm = F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / norm)
