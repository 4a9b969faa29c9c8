"""Vector helpers over ARRAY columns, computed in DOUBLE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def normalize(vec: Column) -> Column:
    """L2-normalised vector; a zero vector stays as it is.

    The length is bound by an outer one-element transform: inside the inner lambda it would be
    worked out again for every value.
    """
    scaled = F.transform(
        F.array(norm(vec)),
        lambda n: F.transform(
            vec, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))
        ),
    )
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def dot_batches(a: Column, b: Column) -> Column:
    """``dot`` for many pairs of equally long, non-empty vectors, one Arrow batch at a time.

    Lambdas over arrays are interpreted value by value; for millions of pairs the trip through
    Arrow is several times cheaper.
    """

    @F.arrow_udf("double")
    def product(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        left = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        right = y.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array((left * right).reshape(len(x), -1).sum(axis=1))

    return product(a, b)
