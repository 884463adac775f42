"""Vector arithmetic as column expressions, all in doubles, and record checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero.

    The array of one struct binds the length, which would be taken anew for each component.
    """
    length = norm(v)
    bound = F.array(F.struct(doubles(v).alias("v"), F.when(length == 0, F.lit(1.0)).otherwise(length).alias("length")))
    return F.transform(bound, lambda x: F.transform(x["v"], lambda y: y / x["length"]))[0]


def cosine_similarity(squared: Column) -> Column:
    """From the squared distance of unit vectors."""
    return 1 - squared / 2


def adc_distance(codes: Column, table: Column) -> Column:
    """Distance of a product-quantized vector: for each subspace the entry of `table` (array of arrays) at its code."""
    return total(F.zip_with(table, codes, lambda row, code: row[code]))


def is_vector(v: Column, dim: int) -> Column:
    """Whether v has `dim` components, all finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("double")


def has_digits(text: Column) -> Column:
    return text.rlike(r"\d")
