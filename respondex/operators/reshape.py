"""From the wide survey to one row per student and question."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.schemas import QUESTIONS, STUDENT_KEY, TEXT_KEY


def to_long(
    survey: DataFrame,
    *,
    questions: Sequence[str] = QUESTIONS,
    key: str = STUDENT_KEY,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Unpivot the answer columns; NULL answers give no row. No shuffle.

    ``keep`` carries further columns along, such as the source order.
    """
    rows = survey.select(
        F.col(key).cast("string").alias("student_id"),
        *keep,
        *[F.col(q).cast("string").alias(q) for q in questions],
    )
    long = rows.unpivot(["student_id", *keep], list(questions), "question_id", "text")
    return long.filter(F.col("text").isNotNull()).select(*TEXT_KEY, "text", *keep)


def any_null(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])


def split_null_keys(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a full key, rows without one). Rows without a key can never be joined."""
    missing = any_null(TEXT_KEY)
    return texts.filter(~missing), texts.filter(missing)


def keep_first(texts: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (student, question): the one that comes first in ``order``.

    An aggregate and not a window: each task first reduces its own rows to one per key,
    so a key that holds a third of all rows sends one row per task through the shuffle.
    The text itself is the last tie-break.
    """
    if not order:
        raise ValueError("keep_first needs at least one order column")
    first = F.min(F.struct(*order, "text"))
    return texts.groupBy(*TEXT_KEY).agg(first.alias("_first")).select(*TEXT_KEY, "_first.text")


def new_texts(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose key is not stored yet. The first answer stored stays for good."""
    return texts.join(stored.select(*TEXT_KEY).distinct(), list(TEXT_KEY), "left_anti")
