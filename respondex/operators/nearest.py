"""The nearest answers for many questions in one pass over the vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from respondex.functions.vectors import matrix_of
from respondex.session import MAX_BROADCAST_KEYS, fits_auto_broadcast, scratch_path

# Questions sent to the tasks at once: this many bytes of vectors.
BLOCK_BYTES = 256 << 20

# Tasks between the many that read and the one that ranks a question's answers.
_MIDDLE_TASKS = 64

_PAIR_VALUES = 1 << 17
_SCREEN_VALUES = 1 << 22


def answers_of(embeddings: DataFrame, students: DataFrame) -> DataFrame:
    """Embeddings of ``students`` only, keeping vectors out of the shuffle if possible.

    Few students: Spark broadcasts them. Many: normally almost every vector belongs to
    one of them, so the others are looked up by id alone and, if few, removed by
    broadcast. Only if both lists are long do the vectors move.
    """
    known = embeddings.filter(F.col("student_id").isNotNull())
    among = known["student_id"] == students["_student"]
    if fits_auto_broadcast(students):
        return known.join(students, among, "left_semi")
    ids = known.select("student_id").distinct()
    strangers = ids.join(students, ids["student_id"] == students["_student"], "left_anti")
    n_strangers = strangers.count()
    if n_strangers == 0:
        return known
    if n_strangers <= MAX_BROADCAST_KEYS:
        return known.join(F.broadcast(strangers), "student_id", "left_anti")
    return known.join(students, among, "left_semi")


def nearest_answers(
    embeddings: DataFrame, queries: DataFrame, limit: int, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``limit`` nearest answers of every question (0: all), with their ``rank``.

    ``queries`` holds a unique ``qid`` and a ``vector``; questions without a vector are
    left out. A task emits, batch by batch, what can still be among the nearest; Spark
    keeps the first ``limit`` of it in the task, then in middle tasks, then for the question.

    The vectors are read once for as many questions as fit into ``block_bytes``. Beyond
    that, each block of questions is a pass of its own that appends to a scratch table.
    """
    asked = queries.filter(F.col("vector").isNotNull()).select("qid", "vector")
    return in_blocks(asked, lambda table: _nearest_block(embeddings, table, limit), block_bytes)


def in_blocks(
    asked: DataFrame, measure: Callable[[pa.Table], DataFrame], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """What ``measure`` gives for ``asked(qid, vector, ...)``, one block of them after the other."""
    first = asked.first()
    block = max(1, block_bytes // (8 * len(first["vector"]) if first and first["vector"] else 8))
    table = asked.limit(block + 1).toArrow()
    if table.num_rows <= block:
        return measure(table)
    # Hashed blocks vary in size, so they are planned half full.
    n_blocks = math.ceil(2 * asked.count() / block)
    number = F.pmod(F.xxhash64("qid"), F.lit(n_blocks))
    spark = asked.sparkSession
    path = scratch_path(spark, "nearest")
    for b in range(n_blocks):
        some = measure(asked.filter(number == b).toArrow())
        some.write.parquet(f"{path}/block={b}")
    return spark.read.parquet(path).drop("block")


def _nearest_block(embeddings: DataFrame, asked: pa.Table, limit: int) -> DataFrame:
    qids = asked.column("qid").combine_chunks()
    if qids.null_count or pc.count_distinct(qids).as_py() != len(qids):
        raise ValueError("every question needs a qid of its own")
    vectors = asked.column("vector").combine_chunks()
    dim = len(vectors[0]) if len(vectors) else 0
    matrix = matrix_of(vectors, dim).astype(np.float32).astype(np.float64)
    if not np.isfinite(matrix).all():
        raise ValueError("question vectors must hold finite numbers only")
    shared = embeddings.sparkSession.sparkContext.broadcast((qids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors = shared.value
        bar = np.full(len(vectors), np.inf)
        for batch in batches if len(vectors) else ():
            for rows, cols, found in _near(batch, vectors, limit, bar):
                yield pa.RecordBatch.from_arrays(
                    [
                        qids.take(pa.array(cols)),
                        batch.column("student_id").take(pa.array(rows)),
                        batch.column("question_id").take(pa.array(rows)),
                        found,
                    ],
                    names=["qid", "student_id", "question_id", "result_distance"],
                )

    qid_type = from_arrow_type(qids.type).simpleString()
    local = embeddings.select("student_id", "question_id", "embedding").mapInArrow(
        run,
        f"qid {qid_type}, student_id string, question_id string, result_distance double",
    )
    if limit <= 0:
        return local.withColumn("rank", F.lit(0))
    return first_of_each(local, limit)


def first_of_each(
    local: DataFrame,
    limit: int,
    by: Sequence[str] = ("result_distance", "student_id", "question_id"),
    few: int | None = None,
) -> DataFrame:
    """The first ``limit`` pairs of every question, with their ``rank``.

    ``few``: the number of tasks, if each has about ``limit`` pairs of a question already. Up to
    as many as the middle tasks these would drop nothing.
    """
    order = [F.asc_nulls_last(c) for c in sorted(by, key=lambda c: c != "result_distance")]
    local = local.withColumn("_middle", F.spark_partition_id() % _MIDDLE_TASKS)
    ways = [("qid", "_middle"), ("qid",)]
    for groups in ways[1:] if few is not None and few <= _MIDDLE_TASKS else ways:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        local = local.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return local.drop("_middle")


def _near(
    batch: pa.RecordBatch, queries: np.ndarray, limit: int, bar: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Rows of the batch, questions and distances of the pairs that can still win.

    ``bar`` holds, per question, a squared distance that ``limit`` answers of one batch do
    not exceed; it is lowered here. One matrix product bounds the squared distances from
    below: |a|^2 + |q|^2 - 2aq less ``slack`` times both squares, which is more than
    rounding can add. What is not above the bar is measured exactly, in element order.
    """
    column = batch.column("embedding")
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    exact = matrix_of(column, queries.shape[1])
    keys = batch.select(["student_id", "question_id"])
    if limit > 0 and len(rows):
        first = _first_copies(exact, keys.take(pa.array(rows)), limit)
        rows, exact = rows[first], exact[first]
    exact = exact.astype(np.float64)
    finite = np.isfinite(exact).all(axis=1)
    odd, strange = rows[~finite], exact[~finite]
    rows, exact = rows[finite], exact[finite]
    slack = 16 * queries.shape[1] * np.finfo(np.float64).eps
    squares = np.einsum("ij,ij->i", exact, exact)
    step = max(1, _SCREEN_VALUES // max(1, len(exact)))
    for start in range(0, len(queries), step) if len(rows) else ():
        some = queries[start : start + step]
        own = np.einsum("ij,ij->i", some, some)
        both = squares[:, None] + own
        low = both * (1 - slack) - 2 * (exact @ some.T)
        limits = bar[start : start + step]
        if 0 < limit <= len(rows):
            high = np.partition(low + 2 * slack * both, limit - 1, axis=0)[limit - 1]
            np.minimum(limits, high, out=limits)
        i, j = np.nonzero(low <= limits)
        for k in range(0, len(i), max(1, _PAIR_VALUES // queries.shape[1])):
            part = slice(k, k + max(1, _PAIR_VALUES // queries.shape[1]))
            gap = (exact[i[part]] - some[j[part]]) ** 2
            found = np.sqrt(np.add.accumulate(gap, axis=1)[:, -1])
            yield rows[i[part]], start + j[part], pa.array(found)
    # NULL, NaN and infinite distances are alike for all questions that lack answers.
    absent = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
    value = np.where(np.isnan(strange).any(axis=1), np.nan, np.inf)
    value = np.concatenate([value, np.zeros(len(absent))])
    missing = np.arange(len(value)) >= len(odd)
    last = np.concatenate([odd, absent])
    if limit > 0 and len(last) > limit:
        table = pa.table({"d": pa.array(value, mask=missing)} | {
            c: keys.column(c).take(pa.array(last)) for c in ("student_id", "question_id")
        })
        by = [(c, "ascending") for c in table.column_names]
        few = pc.sort_indices(table, sort_keys=by).to_numpy()[:limit]
        last, value, missing = last[few], value[few], missing[few]
    for q in np.flatnonzero(np.isinf(bar)) if len(last) else ():
        yield last, np.full(len(last), q), pa.array(value, mask=missing)


def _first_copies(matrix: np.ndarray, keys: pa.RecordBatch, limit: int) -> np.ndarray:
    """True for rows that are among the first ``limit`` of their identical vectors.

    Copies are equally far from any question, so later ones can never win.
    """
    packed = np.ascontiguousarray(matrix)
    packed = packed.view(np.dtype((np.void, packed.dtype.itemsize * packed.shape[1])))
    _, group = np.unique(packed.ravel(), return_inverse=True)
    if len(group) == 0 or np.bincount(group).max() <= limit:
        return np.ones(len(group), dtype=bool)
    table = pa.Table.from_batches([keys]).append_column("group", pa.array(group))
    sort_keys = [(c, "ascending") for c in ("group", "student_id", "question_id")]
    order = pc.sort_indices(table, sort_keys=sort_keys).to_numpy()
    ordered = group[order]
    place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
    first = np.zeros(len(ordered), dtype=bool)
    first[order[place < limit]] = True
    return first
