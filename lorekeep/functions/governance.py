"""The governance flag and the vector measures."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ai_eligible(review_status: Column, source_status: Column, content_status: Column) -> Column:
    """Usable as grounding: approved review, active source and current content."""
    return (
        (review_status == "APPROVED") & (source_status == "ACTIVE") & (content_status == "CURRENT")
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0.0 when either has no length.  For given pairs; ranking a corpus
    goes through ``operators.semantic``."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(_dot(a, b), norms))
