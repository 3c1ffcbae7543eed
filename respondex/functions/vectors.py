"""Vector columns: distance, normalisation and strict checks.

Two distances are offered because they meet different needs. ``l2_distance`` takes two
columns and is made of built-in functions. ``distance_to`` takes one column and a constant
vector and runs as an Arrow UDF, because built-in higher-order functions are evaluated
element by element outside generated code; see the README for the measured difference.
Both add the squares in element order in double precision, so they agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows worked on at once, so that the temporary arrays stay inside the CPU caches.
_BLOCK_VALUES = 1 << 17


def query_vector(values: Sequence[float]) -> np.ndarray:
    """A bound query vector: float32 values, held in double for the sums."""
    vector = np.asarray(values, dtype=np.float32).astype(np.float64)
    if vector.ndim != 1 or vector.size == 0:
        raise ValueError("a query vector must be a non-empty flat list of numbers")
    if not np.isfinite(vector).all():
        raise ValueError("a query vector must hold finite numbers only")
    return vector


def matrix_of(vectors: pa.Array, dim: int) -> np.ndarray:
    """The non-null vectors of an Arrow list array as one (rows, dim) float matrix.

    A vector of another length or with a null element is an error.
    """
    present = vectors.drop_null() if vectors.null_count else vectors
    flat = present.flatten()
    lengths = np.diff(present.offsets.to_numpy(zero_copy_only=False))
    if (lengths != dim).any():
        bad = int(lengths[lengths != dim][0])
        raise ValueError(f"vector of length {bad}, expected {dim}")
    if flat.null_count:
        raise ValueError("vector with a null element")
    return flat.to_numpy(zero_copy_only=False).reshape(len(present), dim)


def distances(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Row distances to ``vector``; squares are added in element order."""
    out = np.empty(len(matrix), dtype=np.float64)
    step = max(1, _BLOCK_VALUES // vector.size)
    for start in range(0, len(matrix), step):
        diff = matrix[start : start + step].astype(np.float64)
        diff -= vector
        diff *= diff
        np.add.accumulate(diff, axis=1, out=diff)
        np.sqrt(diff[:, -1], out=out[start : start + step])
    return out


def sound(vectors: pa.Array, dim: int) -> np.ndarray:
    """True for rows that are NULL or a vector of ``dim`` non-null elements."""
    lengths = vectors.value_lengths().fill_null(dim).to_numpy(zero_copy_only=False)
    good = lengths == dim
    if vectors.flatten().null_count:
        owners = vectors.value_parent_indices().filter(vectors.flatten().is_null())
        good[owners.to_numpy()] = False
    return good


#: Stands for the distance of a faulty vector until it is known whether it matters.
FAULT = -1.0


def distance_to(embedding: Column | str, vector: Sequence[float]) -> Column:
    """Euclidean distance of a vector column to one constant vector.

    NULL for a NULL vector; a wrong length or a null element fails the query.
    """
    return checked(distance_or_fault(embedding, vector))


def distance_or_fault(embedding: Column | str, vector: Sequence[float]) -> Column:
    """The same, for rows that may turn out not to matter.

    NULL for a NULL vector, ``FAULT`` for one of another length or with a null element.
    """
    bound = query_vector(vector)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        good = sound(column, bound.size)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        full = np.where(good, 0.0, FAULT)
        whole = column if good.all() else column.filter(pa.array(good))
        full[good & valid] = distances(matrix_of(whole, bound.size), bound)
        return pa.array(full, mask=~valid)

    return run(embedding)


def checked(distance: Column) -> Column:
    """The distance; a faulty vector fails the query."""
    message = F.lit("a vector has another length than the question's or a null element")
    return F.when(distance < 0, F.raise_error(message).cast("double")).otherwise(distance)


def as_vector(column: Column | str, dim: int) -> Column:
    """Cast to ``array<float>`` and insist on the length and on non-null elements."""
    vector = (F.col(column) if isinstance(column, str) else column).cast("array<float>")
    return (
        F.when(vector.isNull(), F.lit(None))
        .when(
            F.size(vector) != dim,
            F.raise_error(
                F.concat(
                    F.lit("vector of length "),
                    F.size(vector).cast("string"),
                    F.lit(f", expected {dim}"),
                )
            ),
        )
        .when(has_null_element(vector), F.raise_error(F.lit("vector with a null element")))
        .otherwise(vector)
        .cast("array<float>")
    )


def has_null_element(vector: Column) -> Column:
    return F.exists(vector, lambda x: x.isNull())


def l2_distance(a: Column, b: Column, dim: int) -> Column:
    """Euclidean distance of two vector columns."""
    a, b = as_vector(a, dim), as_vector(b, dim)
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Scale to length one; the zero vector stays as it is."""

    def scaled(norm: Column) -> Column:
        return F.when(norm == 0.0, vector.cast("array<double>")).otherwise(
            F.transform(vector, lambda x: x.cast("double") / norm)
        )

    # Going through a one-element array makes the norm a lambda variable: it is then
    # computed once per vector and not once per element.
    return F.transform(F.array(l2_norm(vector)), scaled)[0]
