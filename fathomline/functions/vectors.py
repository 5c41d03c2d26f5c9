"""Column functions on ``array<float>`` vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.binding import let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return _total(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine_distance(left: Column, right: Column) -> Column:
    """``1 - cos``; NULL for a missing or zero vector and for unequal lengths."""

    def compare(a: Column, b: Column, scale: Column) -> Column:
        usable = (F.size(a) == F.size(b)) & (scale > 0)
        # Rounding of equal vectors may end below zero.
        return F.when(usable, F.greatest(1 - dot(a, b) / scale, F.lit(0.0)))

    return let(left, lambda a: let(right, lambda b: let(norm(a) * norm(b), lambda scale: compare(a, b, scale))))


def l2_normalize(vector: Column) -> Column:
    """The vector divided by its length; a zero vector is returned as it is."""

    def scaled(v: Column, length: Column) -> Column:
        return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)

    doubles = F.transform(vector, lambda x: x.cast("double"))
    return let(doubles, lambda v: let(norm(v), lambda length: scaled(v, length)))


def check_dims(df: DataFrame, column: str, dims: int) -> DataFrame:
    """Rows whose vector is present but not ``dims`` long."""
    return df.where(F.col(column).isNotNull() & (F.size(column) != dims))
