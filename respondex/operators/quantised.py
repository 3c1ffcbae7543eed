"""Exact search through an 8-bit copy of the vectors.

Every vector is stored twice: whole, and as one byte for each number with the length of the
error that makes. The distance to the copy, give or take that error, bounds the distance to
the vector. A search reads the small copies, keeps the vectors whose lower bound is within
the reach of ``limit`` upper bounds, and measures only those in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respondex.functions.vectors import matrix_of, query_vector, sound
from respondex.operators.nearest import answers_of
from respondex.operators.search import MAX_TOP, search, students_of
from respondex.schemas import EMBEDDINGS, QUESTIONS, STUDENT_KEY, TEXT_KEY
from respondex.session import MAX_BROADCAST_KEYS, drop_scratch, scratch_path

_LEVELS = 255
_SLACK = 1e-9
_BLOCK_VALUES = 1 << 20

_ROW = T.StructField("row", T.LongType())
_PART = T.StructField("part", T.IntegerType())
_WHOLE = T.StructType([_ROW, *EMBEDDINGS.fields, _PART])
_CODE = "struct<code: binary, low: double, step: double, error: double>"
_CODES = T.StructType(
    [_ROW, *EMBEDDINGS.fields[:2], T.StructField("code", T.BinaryType())]
    + [T.StructField(n, T.DoubleType()) for n in ("low", "step", "error")]
)


def _blocks(n: int, dim: int) -> Iterator[slice]:
    step = max(1, _BLOCK_VALUES // max(1, dim))
    for k in range(0, n, step):
        yield slice(k, k + step)


def _decoded(codes: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    return low[:, None] + step[:, None] * codes


def code_of(embedding: Column | str, dim: int) -> Column:
    """``struct<code, low, step, error>``; NULL for a vector without a finite distance.

    A number x is about low + step * byte. ``error`` is at least the distance between the
    vector and what its code stands for.
    """

    @F.arrow_udf(_CODE)
    def run(column: pa.Array) -> pa.Array:
        good = sound(column, dim) & column.is_valid().to_numpy(zero_copy_only=False)
        matrix = matrix_of(column.filter(pa.array(good)), dim).astype(np.float64)
        finite = np.isfinite(matrix).all(axis=1)
        where, matrix = np.flatnonzero(good)[finite], matrix[finite]
        codes = np.zeros((len(matrix), dim), np.uint8)
        low = matrix.min(axis=1, initial=0.0 if dim == 0 else np.inf)
        step = (matrix.max(axis=1, initial=0.0 if dim == 0 else -np.inf) - low) / _LEVELS
        error = np.zeros(len(matrix))
        for b in _blocks(len(matrix), dim):
            scale = np.where(step[b] > 0, step[b], 1.0)
            codes[b] = np.rint((matrix[b] - low[b, None]) / scale[:, None])
            off = np.linalg.norm(matrix[b] - _decoded(codes[b], low[b], step[b]), axis=1)
            size = np.linalg.norm(matrix[b], axis=1)
            error[b] = off + _SLACK * (off + size)
        packed: list[bytes | None] = [None] * len(column)
        for i, k in enumerate(where):
            packed[k] = codes[i].tobytes()
        numbers = [np.zeros(len(column)) for _ in range(3)]
        for out, values in zip(numbers, (low, step, error)):
            out[where] = values
        absent = np.ones(len(column), bool)
        absent[where] = False
        return pa.StructArray.from_arrays(
            [pa.array(packed, pa.binary()), *map(pa.array, numbers)],
            names=["code", "low", "step", "error"],
            mask=pa.array(absent),
        )

    return run(embedding)


def bounds_to(vector: Sequence[float]) -> Column:
    """``struct<least, most>``: between them lies the distance of a coded vector."""
    bound = query_vector(vector)

    @F.arrow_udf("struct<least: double, most: double>")
    def run(code: pa.Array, low: pa.Array, step: pa.Array, error: pa.Array) -> pa.Array:
        valid = code.is_valid().to_numpy(zero_copy_only=False)
        some = pa.array(valid)
        body = b"".join(code.filter(some).to_pylist())
        n = int(valid.sum())
        if len(body) != n * bound.size:
            raise ValueError(f"vector of length {bound.size}, expected {len(body) // n}")
        codes = np.frombuffer(body, np.uint8).reshape(n, bound.size)
        low, step, error = (c.filter(some).to_numpy() for c in (low, step, error))
        away = np.zeros(len(codes))
        for b in _blocks(len(codes), bound.size):
            away[b] = np.linalg.norm(_decoded(codes[b], low[b], step[b]) - bound, axis=1)
        slack = error + _SLACK * (1 + away)
        out = [np.zeros(len(valid)), np.zeros(len(valid))]
        out[0][valid], out[1][valid] = np.maximum(away - slack, 0.0), away + slack
        return pa.StructArray.from_arrays(
            [pa.array(x) for x in out], names=["least", "most"], mask=pa.array(~valid)
        )

    return run("code", "low", "step", "error")


def store_quantised(embeddings: DataFrame, path: str, dim: int) -> None:
    """Store ``embeddings`` under ``path``: whole in ``vectors``, as codes in ``codes``.

    Rows are numbered as they are written, and ``part`` is the folder of the task that wrote
    them, so few rows are found without reading all folders. Codes are written last.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("row"),
        *EMBEDDINGS.fieldNames(),
        F.spark_partition_id().alias("part"),
    )
    rows.write.partitionBy("part").parquet(f"{path}/vectors")
    code = code_of("embedding", dim).alias("_code")
    coded = whole_vectors(spark, path).select("row", *TEXT_KEY, code)
    coded.select("row", *TEXT_KEY, "_code.*").write.parquet(f"{path}/codes")


def whole_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_WHOLE).parquet(f"{path}/vectors")


def codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CODES).parquet(f"{path}/codes")


def candidate_rows(
    survey: DataFrame, path: str, vector: Sequence[float], limit: int, key: str = STUDENT_KEY
) -> DataFrame | None:
    """row, part of the vectors to be measured in full; None if that must be all.

    The ``limit`` smallest upper bounds cover at least as many results, so whatever has a
    lower bound beyond them is out. Vectors without a code have no number for a distance:
    they can't be among the first, but a faulty one has to be noticed.
    """
    spark = survey.sparkSession
    students = students_of(survey, key).where(F.col("_student").isNotNull())
    theirs = answers_of(codes(spark, path), students)
    bounds = theirs.select("row", bounds_to(vector).alias("_bounds"))
    most = F.col("_bounds.most")
    reach = bounds.where(most.isNotNull()).select(most.alias("most")).orderBy("most").limit(limit)
    n, last = reach.agg(F.count(F.lit(1)), F.max("most")).first()
    if n < limit:
        return None
    near = bounds.where(F.col("_bounds").isNull() | (F.col("_bounds.least") <= last))
    # A row's number holds the task that wrote it above the 33rd bit.
    return near.select("row", F.shiftright("row", 33).cast("int").alias("part"))


def search_quantised(
    survey: DataFrame,
    path: str,
    vector: Sequence[float],
    *,
    limit: int = 25,
    key: str = STUDENT_KEY,
    questions: Sequence[str] = QUESTIONS,
    include_embedding: bool = True,
) -> DataFrame:
    """What ``search`` gives over all vectors stored by ``store_quantised``.

    The codes are read twice, once for the bar and once for what passes it; the numbers of
    what passes are written, and only these vectors are read in full. All vectors are read if
    all rows are wanted, for a limit above 10,000, or if there are too few results.
    """
    spark = survey.sparkSession
    options = {"limit": limit, "key": key, "questions": questions}
    options["include_embedding"] = include_embedding
    stored = whole_vectors(spark, path)
    near = candidate_rows(survey, path, vector, limit, key) if 0 < limit <= MAX_TOP else None
    if near is None:
        return search(survey, stored.drop("row", "part"), vector, **options)
    scratch = scratch_path(spark, "near-rows")
    near.write.parquet(scratch)
    rows = spark.read.parquet(scratch)
    n = rows.count()
    if n <= MAX_BROADCAST_KEYS:
        # Both columns: those of the few rows also tell which folders need no look.
        parts = [r["part"] for r in rows.select("part").distinct().collect()]
        stored = stored.where(F.col("part").isin(parts)).join(
            F.broadcast(rows.select("row")), "row", "left_semi"
        )
    else:
        stored = stored.join(rows, ["row", "part"], "left_semi")
    return search(survey, stored.drop("row", "part"), vector, **options)


def drop_quantised(spark: SparkSession, path: str) -> None:
    """Delete a store that lies in the scratch folder."""
    drop_scratch(spark, path)
