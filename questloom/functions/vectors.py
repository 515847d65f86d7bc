"""Vector expressions: normalisation and shape checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest positive normal 32-bit float.
MIN_POSITIVE = 1.1754943508222875e-38


def l2_normalize(vector: Column) -> Column:
    """Scale a float vector to unit length without overflow.

    Divides by the largest magnitude before squaring.  A vector that is all
    zero, has a non-finite element or a norm too small to divide by is
    returned unchanged.
    """
    peak = F.aggregate(vector, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))

    def scaled(norm_and_vector: Column) -> Column:
        norm, original = norm_and_vector["norm"], norm_and_vector["v"]
        usable = (norm > MIN_POSITIVE) & (norm < float("inf"))
        return F.when(
            usable, F.transform(original, lambda x: (x.cast("double") / norm).cast("float"))
        ).otherwise(original)

    def norm_of(peak_and_vector: Column) -> Column:
        p, v = peak_and_vector["peak"], peak_and_vector["v"]
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") / p) * (x.cast("double") / p))
        return F.struct((p * F.sqrt(total)).alias("norm"), v.alias("v"))

    # Nested transforms over one-element arrays bind peak and norm once instead
    # of repeating them per element.
    first = F.array(F.struct(peak.alias("peak"), vector.alias("v")))
    ok = (peak > 0) & (peak < float("inf"))
    return F.when(ok, F.transform(F.transform(first, norm_of), scaled)[0]).otherwise(vector)


def normalize_rows(matrix: np.ndarray) -> np.ndarray:
    """The same rule for a block of rows inside a task."""
    block = np.asarray(matrix, dtype=np.float32)
    wide = block.astype(np.float64)
    peak = np.abs(wide).max(axis=1, initial=0.0)
    usable = (peak > 0) & np.isfinite(peak)
    safe_peak = np.where(usable, peak, 1.0)[:, None]
    norm = safe_peak[:, 0] * np.sqrt(np.square(wide / safe_peak).sum(axis=1))
    usable &= (norm > MIN_POSITIVE) & np.isfinite(norm)
    out = block.copy()
    out[usable] = (wide[usable] / norm[usable, None]).astype(np.float32)
    return out


def vector_verdict(vector: Column, dim: int) -> Column:
    """``OK``, or why the vector breaks the shape rule."""
    return (
        F.when(vector.isNull(), "NULL_VECTOR")
        .when(F.size(vector) != dim, "BAD_DIMENSION")
        .when(F.exists(vector, lambda x: x.isNull()), "NULL_ELEMENT")
        .when(F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "NOT_FINITE")
        .otherwise("OK")
    )


def require_vector(vector: Column, dim: int) -> Column:
    """The vector itself; fails the job on a row that breaks the shape rule."""
    verdict = vector_verdict(vector, dim)
    return F.when(verdict == "OK", vector).otherwise(
        F.raise_error(F.concat(F.lit(f"vector of {dim} floats expected: "), verdict))
    )
