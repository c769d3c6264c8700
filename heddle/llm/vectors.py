"""Vector columns as whole-number matrices: what clustering and code compression share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are; null components, NaN and infinities are not."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def widest(dims: int) -> int:
    """The largest component for which squared distances over ``dims`` components fit 64 bits."""
    return int(math.isqrt((1 << 63) // max(dims, 1)) // 2)


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as floor(scale * x)): rows with exactly ``dims`` usable components.

    ``vectors`` is a list array of doubles. Components so large that squared distances would not fit 64 bits raise
    ValueError, as no right result could be stored.
    """
    there = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)) == dims
    rows = np.flatnonzero(there)
    flat = vectors.filter(pa.array(there)).flatten() if dims else pa.array([], pa.float64())
    # A null component becomes NaN here, and goes with the others that are no numbers.
    x = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), dims)
    fine = np.isfinite(x).all(1)
    x = np.floor(x[fine] * scale)
    if x.size and np.abs(x).max() > widest(dims):
        raise ValueError(f"a component beyond {widest(dims) / scale:.3g} has no exact squared distance in 64 bits")
    return rows[fine], x.astype(np.int64)


def blocks(n: int, most: int) -> Iterator[slice]:
    """Slices of at most ``most`` rows."""
    return (slice(a, min(a + most, n)) for a in range(0, n, most))
