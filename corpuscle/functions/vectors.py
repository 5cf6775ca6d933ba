"""Dense and sparse vector expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector in double precision; the norm counts as 1e-12 at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


def clean_sparse(weights: Column) -> Column:
    """A sparse vector without null, zero and negative weights; null for null."""
    return F.map_filter(weights, lambda _, w: w.isNotNull() & (w > 0))


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors (double) of an Arrow list column whose lists all have ``width`` numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
