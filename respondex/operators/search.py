"""Rank answers by distance to one question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.functions.text import display_line, pick_answer
from respondex.functions.vectors import checked, distance_or_fault
from respondex.operators.keys import assign_ids
from respondex.schemas import QUESTIONS, STUDENT_KEY
from respondex.session import fits_auto_broadcast, input_bytes, scratch_path

# Up to this limit the winners' keys are small enough to broadcast.
MAX_TOP = 10_000

# Tasks between the many that read and the one that merges.
_MIDDLE_TASKS = 64

# Up to this much input the direct route is quicker. Beyond it, every task would hand
# ``limit`` wide rows to the final merge, where the narrow route hands keys.
DIRECT_INPUT_BYTES = 4 << 30


def copy_order(columns: Sequence[str]) -> list[Column]:
    """Order among survey rows of one key: by all their columns, NULL last."""
    return [F.asc_nulls_last(c) for c in columns]


def result_order(key: Column, columns: Sequence[str] = ()) -> list[Column]:
    """Nearest first; NaN, then NULL at the end. Ties go by the key as text, by question,
    and then by the survey's columns, on every route."""
    first = [F.col("result_distance"), key.cast("string"), F.col("result_question_id")]
    return [*[F.asc_nulls_last(c) for c in first], *copy_order(columns)]


def students_of(survey: DataFrame, key: str) -> DataFrame:
    """The distinct survey keys; repeated ones collapse before the shuffle."""
    return survey.select(F.col(key).cast("string").alias("_student")).distinct()


def search(
    survey: DataFrame,
    embeddings: DataFrame,
    vector: Sequence[float],
    *,
    limit: int = 25,
    key: str = STUDENT_KEY,
    questions: Sequence[str] = QUESTIONS,
    include_embedding: bool = True,
    route: str = "auto",
) -> DataFrame:
    """The answers nearest to ``vector``, nearest first.

    Every survey row comes with each of its answers that has an entry in ``embeddings``;
    a row without any comes once, with NULL distance and NULL text, after all others.
    ``limit`` counts result rows; 0 or less means all. Filter ``survey`` first to search
    among some students only. A faulty vector of one of these students fails the search;
    vectors of others don't matter. Survey columns must be sortable.

    ``route`` is "direct" (join, then rank), "narrow" (rank keys, then fetch the winners)
    or "auto": direct for small input (a survey that Spark broadcasts, up to 4 GB of
    embeddings) or if all rows are wanted. Both give the same rows. Nothing runs before the
    caller acts, but for a limit above 10,000: its rows are numbered by range, so that no
    task merges them all, and distances and rows that can count are written for that.
    """
    if route not in ("auto", "direct", "narrow"):
        raise ValueError(f"unknown route {route!r}")
    if route == "narrow" and not 0 < limit <= MAX_TOP:
        raise ValueError(f"the narrow route takes a limit from 1 to {MAX_TOP}")
    if route == "auto":
        small = fits_auto_broadcast(survey) and input_bytes(embeddings) <= DIRECT_INPUT_BYTES
        route = "narrow" if 0 < limit <= MAX_TOP and not small else "direct"
    found = (
        _narrow(survey, embeddings, vector, limit, key)
        if route == "narrow"
        else _direct(survey, embeddings, vector, key)
    )
    columns = [*survey.columns, *(["embedding"] if include_embedding else [])]
    found = found.select(
        *columns, "result_question_id", checked(F.col("result_distance")).alias("result_distance")
    )
    order = result_order(F.col(key), survey.columns)
    if limit > MAX_TOP:
        ordered = _first_many(found, order, limit).orderBy(*order)
    elif limit > 0:
        ordered = found.orderBy(*order).limit(limit)
    else:
        ordered = found.orderBy(*order)
    text = pick_answer(F.col("result_question_id"), questions)
    return ordered.withColumn("result_text", text)


def _first_many(found: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows for a limit too large for one task.

    The distances alone are written, sorted by range and numbered; rows beyond the last one
    that counts drop out. What is left is written and then sorted and numbered as whole
    rows. So vectors are measured twice, and not again for the sampling of each sort.
    """
    distance = F.col("result_distance")
    distances = written(found.select("result_distance"), "distances")
    numbered = assign_ids(distances, [F.asc_nulls_last(distance)], "_place")
    last = numbered.filter(F.col("_place") == limit).first()
    if last is None:
        return found
    cut = last["result_distance"]
    if cut is not None:
        found = found.filter(distance <= cut)  # NaN is above all numbers
    near = written(found, "near")
    return assign_ids(near, order, "_place").filter(F.col("_place") <= limit).drop("_place")


def written(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _scored(embeddings: DataFrame, vector: Sequence[float]) -> DataFrame:
    return embeddings.select(
        F.col("student_id").alias("_student"),
        F.col("question_id").alias("result_question_id"),
        "embedding",
        distance_or_fault("embedding", vector).alias("result_distance"),
    )


def _no_answer() -> list[Column]:
    """The columns of a scored answer for a student who has none."""
    types = {
        "result_question_id": "string",
        "embedding": "array<float>",
        "result_distance": "double",
    }
    return [F.lit(None).cast(kind).alias(name) for name, kind in types.items()]


def _same_student(survey: DataFrame, other: DataFrame, key: str) -> Column:
    return survey[key].cast("string").eqNullSafe(other["_student"])


def _narrow(
    survey: DataFrame, embeddings: DataFrame, vector: Sequence[float], limit: int, key: str
) -> DataFrame:
    """A superset of the first ``limit`` result rows, at most a few per student.

    1. Each student's best distance is an aggregate, so a hot student costs one row per
       task, and neither vectors nor answers enter the shuffle. The ``limit`` best
       students cover the ``limit`` best rows, as each of them has at least one row.
    2. The answers of those students are looked up again, and again only ``limit`` of
       them can win: every answer stands for at least one result row.
    3. The winners are broadcast to the survey, which is never shuffled.
    """
    students = students_of(survey, key)
    searched = embeddings
    if fits_auto_broadcast(students):  # spares measuring others, which count for nothing
        among = embeddings["student_id"] == students["_student"]
        searched = embeddings.join(students, among, "left_semi")
    best = (
        _scored(searched, vector)
        .groupBy("_student")
        .agg(F.min("result_distance").alias("_best"), F.count(F.lit(1)).alias("_entries"))
    )
    ranked = [F.asc_nulls_last("_best"), F.asc_nulls_last("_student")]
    known = students.join(best, "_student", "left").withColumn("_best", checked(F.col("_best")))
    finalists = _first(known, ranked, limit)
    present = finalists.filter(F.col("_entries").isNotNull())
    absent = finalists.filter(F.col("_entries").isNull())
    theirs = embeddings.join(
        F.broadcast(present), embeddings["student_id"] == present["_student"], "left_semi"
    )
    nearest = _first(_scored(theirs, vector), result_order(F.col("_student")), limit)
    answer = F.struct("result_question_id", "embedding", "result_distance")
    winners = (
        nearest.unionByName(absent.select("_student", *_no_answer()))
        .groupBy("_student")
        .agg(F.collect_list(answer).alias("_answers"))
    )
    rows = survey.join(F.broadcast(winners), _same_student(survey, winners, key))
    # Copies of a survey row share their answers, so ``limit`` of them are enough. They
    # are dropped before the answers multiply the rows.
    few = _thinned(rows, copy_order(survey.columns), limit, "_student")
    return few.withColumn("_answer", F.explode("_answers")).select(*survey.columns, "_answer.*")


def _first(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    return _thinned(rows, order, limit).orderBy(*order).limit(limit)


def _thinned(
    rows: DataFrame, order: Sequence[Column], limit: int, *groups: str
) -> DataFrame:
    """Rows that hold the first ``limit`` of each group, at most that many per middle task.

    A hot key can put ``limit`` candidates into every task. Merging them in some middle
    tasks keeps the load off the driver, and the shuffle makes the pass over the table a
    stage of its own, so that no broadcast has to wait for it.
    """
    spark = rows.sparkSession
    if limit > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return rows  # Spark wouldn't drop anything inside its tasks
    place = F.row_number().over(Window.partitionBy("_middle", *groups).orderBy(*order))
    return (
        rows.withColumn("_middle", F.spark_partition_id() % _MIDDLE_TASKS)
        .withColumn("_place", place)
        .filter(F.col("_place") <= limit)
        .drop("_middle", "_place")
    )


def _direct(
    survey: DataFrame, embeddings: DataFrame, vector: Sequence[float], key: str
) -> DataFrame:
    """All result rows, for the caller to rank."""
    return _joined(survey, _scored(embeddings, vector), key)


def _joined(survey: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Survey rows with each of their answers, or with none.

    Written as matches plus rows without a match, and not as one outer join: Spark can
    split a hot key on both sides of an inner join, but only on the left of an outer one,
    and it can broadcast a small survey only to an inner join.
    """
    text_key = survey[key].cast("string")
    matched = survey.join(scored, text_key == scored["_student"]).drop("_student")
    known = scored.select("_student")
    if fits_auto_broadcast(survey):
        known = known.join(students_of(survey, key), "_student", "left_semi")
    known = known.distinct()
    unmatched = survey.join(known, text_key == known["_student"], "left_anti")
    return matched.unionByName(unmatched.select("*", *_no_answer()))


def join_answers(
    survey: DataFrame, embeddings: DataFrame, key: str = STUDENT_KEY
) -> DataFrame:
    """One row per survey row and answer, as a search of all rows joins them."""
    answers = embeddings.select(
        F.col("student_id").alias("_student"),
        F.col("question_id").alias("result_question_id"),
        "embedding",
        F.lit(None).cast("double").alias("result_distance"),
    )
    return _joined(survey, answers, key).drop("result_distance")


def display_lines(results: DataFrame, key: str = STUDENT_KEY) -> DataFrame:
    """Search results as printable lines, in the order they come in."""
    line = display_line(F.col("result_distance"), F.col(key), F.col("result_text"))
    return results.select(line.alias("line"))
