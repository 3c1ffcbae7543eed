"""Search for many questions at once, with the answers' texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondex.functions.text import pick_answer
from respondex.operators.keys import assign_ids, number_within
from respondex.operators.nearest import answers_of, nearest_answers
from respondex.operators.search import MAX_TOP, copy_order, result_order, students_of, written
from respondex.schemas import QUESTIONS, STUDENT_KEY
from respondex.session import scratch_path

# Students without answers meet the questions in so many slots of each.
_SLOTS = 16


def search_batch(
    survey: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    *,
    limit: int = 5,
    key: str = STUDENT_KEY,
    questions: Sequence[str] = QUESTIONS,
    nearest: Callable[[DataFrame, DataFrame, int], DataFrame] = nearest_answers,
    students: DataFrame | None = None,
) -> DataFrame:
    """For every question in ``queries(qid, vector)`` what ``search`` gives, plus a rank.

    Columns: ``qid, result_rank``, the survey's, ``result_question_id, result_distance,
    result_text``. A question without a vector gets no rows. ``limit`` 0 or less means all
    rows; these are sorted by range when the caller's plan is made, so that the rows of one
    question lie in many tasks. The same goes for a limit above 10,000. Only keys and numbers
    are sorted; the other columns of the survey join the caller's plan if it wants them.

    The pass over the vectors runs here and leaves its winners, ``limit`` keys per
    question, in a scratch table; texts are fetched when the caller acts. ``queries``
    should be a stored table, as it is read more than once. ``students`` are what ``students_of``
    gives for the survey, if the caller has stored them.
    """
    students = students_of(survey, key) if students is None else students
    candidates = answers_of(embeddings, students.filter(F.col("_student").isNotNull()))
    path = scratch_path(survey.sparkSession, "winners")
    nearest(candidates, queries, limit).write.parquet(path)
    stored = survey.sparkSession.read.parquet(path)
    near = stored.select(
        "qid",
        F.col("student_id").alias("_student"),
        F.col("question_id").alias("result_question_id"),
        "result_distance",
    )
    # Students without any answer come last and matter only if answers run out, which
    # they do for all questions alike.
    if limit <= 0 or stored.filter(F.col("rank") == limit).isEmpty():
        near = near.unionByName(_absent(students, candidates, queries, limit))
    answers = _with_answers if 0 < limit <= MAX_TOP else _with_many_answers
    return answers(survey, near, limit, key, questions)


def _absent(
    students: DataFrame, candidates: DataFrame, queries: DataFrame, limit: int
) -> DataFrame:
    """The students without answers, up to ``limit``, for every question that has a vector.

    Every student meets every question, as the result wants it: both sides are dealt to
    slots, and an equi-join on pairs of slots brings them together in many tasks.
    """
    known = candidates.select(F.col("student_id").alias("_student")).distinct()
    without = students.join(known, "_student", "left_anti")
    if limit > 0:
        without = without.orderBy(F.asc_nulls_last("_student")).limit(limit)
    every = F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1)))
    slot = F.pmod(F.xxhash64(F.lit(7), F.col("_student")), F.lit(_SLOTS)).cast("int")
    without = without.select("_student", slot.alias("_mine"), every.alias("_theirs"))
    asked = queries.filter(F.col("vector").isNotNull()).select(
        "qid",
        F.pmod(F.xxhash64(F.lit(7), F.col("qid")), F.lit(_SLOTS)).cast("int").alias("_theirs"),
        every.alias("_mine"),
    )
    return without.join(asked, ["_mine", "_theirs"]).select(
        "qid",
        "_student",
        F.lit(None).cast("string").alias("result_question_id"),
        F.lit(None).cast("double").alias("result_distance"),
    )


def _with_answers(
    survey: DataFrame, near: DataFrame, limit: int, key: str, questions: Sequence[str]
) -> DataFrame:
    """Join the winners to their survey rows and rank again.

    A repeated key multiplies result rows, so ``limit`` rows of one key are all that can
    count; the window drops the others inside each task before anything is shuffled.
    """
    wanted = near.select("_student").distinct()
    theirs = survey.join(
        wanted, survey[key].cast("string").eqNullSafe(wanted["_student"]), "left_semi"
    )
    copies = Window.partitionBy(F.col(key).cast("string")).orderBy(*copy_order(survey.columns))
    rows = (
        theirs.withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= limit)
        .drop("_copy")
    )
    found = rows.join(near, rows[key].cast("string").eqNullSafe(near["_student"]))
    order = result_order(F.col(key), survey.columns)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    found = found.select("qid", *survey.columns, "result_question_id", "result_distance")
    found = found.withColumn("result_rank", rank).filter(F.col("result_rank") <= limit)
    return _results(found, survey.columns, questions)


def _with_many_answers(
    survey: DataFrame, near: DataFrame, limit: int, key: str, questions: Sequence[str]
) -> DataFrame:
    """The same for all rows, or more than a task can rank.

    A survey row meets every question, so its texts must not be sorted with the results.
    The rows are numbered in the order that settles ties, and the numbers are ranked in
    their place. The other columns are looked up by that number; Spark leaves this join out
    if the caller selects none of them, as the numbers are unique.
    """
    numbered = assign_ids(
        survey, [F.asc_nulls_last(F.col(key).cast("string")), *copy_order(survey.columns)], "_row"
    )
    keys = written(numbered.select("_row", key), "survey-keys")
    rows = keys.withColumn("_same", F.col(key).cast("string"))
    if limit > 0:
        copy = F.row_number().over(Window.partitionBy("_same").orderBy("_row"))
        rows = rows.withColumn("_copy", copy).filter(F.col("_copy") <= limit).drop("_copy")
    found = rows.join(near, rows["_same"].eqNullSafe(near["_student"])).select(
        "qid", key, "_row", "result_question_id", "result_distance"
    )
    ranked = number_within(found, "qid", result_order(F.col(key), ["_row"]), "result_rank")
    others = [c for c in survey.columns if c != key]
    if others:
        rest = F.struct(*[F.col(c) for c in others])
        texts = numbered.groupBy("_row").agg(F.first(rest).alias("_rest"))
        ranked = ranked.join(texts, "_row", "left").withColumns(
            {c: F.col("_rest").getField(c) for c in others}
        )
    kept = ranked.filter((F.col("result_rank") <= limit) | F.lit(limit <= 0))
    return _results(kept, survey.columns, questions)


def _results(found: DataFrame, columns: Sequence[str], questions: Sequence[str]) -> DataFrame:
    return found.select(
        "qid",
        "result_rank",
        *columns,
        "result_question_id",
        "result_distance",
        pick_answer(F.col("result_question_id"), questions).alias("result_text"),
    )
