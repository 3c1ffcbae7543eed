"""Quality rules: a threshold table compiled into one projection.

Measures are built-in column expressions over the whole text; a rule bounds one ratio of
two of them. No user function runs and nothing is shuffled, so a long text costs time in
its own row only.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondex.llm.shared import SPACE

#: Frequent words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de du est et la le les pas pour qui que sur un une "
    "al como con el en las los más no para por se su una y"
).split()

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
)


class Rule(NamedTuple):
    """``least <= per / of <= most``; a bound of None is open. ``of`` None divides by one."""

    name: str
    per: str
    of: str | None
    least: float | None
    most: float | None
    base: bool = False


RULES = (
    Rule("few words", "n_words", None, 50, None, base=True),
    Rule("repetition", "n_repeat_words", "n_words", None, 0.5, base=True),
    Rule("word length", "word_chars", "n_words", 2, 12),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop words", "n_stop_words", "n_words", 0.04, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _broken(rule: Rule) -> Column:
    """Products of integers and bounds in hundredths, so no quotient is rounded."""
    of = F.col(rule.of) if rule.of else F.lit(1)
    value = 100 * F.col(rule.per)
    tests = []
    if rule.least is not None:
        tests.append(value < F.lit(round(100 * rule.least)) * of)
    if rule.most is not None:
        tests.append(value > F.lit(round(100 * rule.most)) * of)
    return reduce(lambda a, b: a | b, tests)


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """_row (all columns of ``docs``), _place and the measures of its text.

    A filter that asks for ``_place``, which isn't deterministic, stays above the measures;
    Spark would otherwise compute them for the filter once more, some of them many times.

    Windows carry their place as a suffix of eight digits: sorting the strings brings equal
    windows together, and neighbours that are equal up to the suffix give the places.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )
    split = base.select(
        "_row",
        "_text",
        F.filter(F.split("_text", SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    count = F.greatest(F.size("_words") - 2, F.lit(0))
    triples = F.arrays_zip(*[F.slice("_words", i, count).alias(f"w{i}") for i in (1, 2, 3)])
    windows = split.select(
        "*",
        F.transform(
            triples,
            lambda w, i: F.concat_ws(
                " ", w["w1"], w["w2"], w["w3"], F.lpad(i.cast("string"), 8, "0")
            ),
        ).alias("_windows"),
    )
    ordered = windows.select(
        "_row", "_text", "_words", "_lines", F.sort_array("_windows").alias("_sorted")
    )
    pairs = F.greatest(F.size("_sorted") - 1, F.lit(0))
    places = F.flatten(
        F.zip_with(
            F.slice("_sorted", 1, pairs),
            F.slice("_sorted", 2, pairs),
            lambda a, b: F.when(
                F.substring_index(a, " ", 3) == F.substring_index(b, " ", 3),
                F.array(F.right(a, F.lit(8)).cast("int"), F.right(b, F.lit(8)).cast("int")),
            ).otherwise(F.array().cast("array<int>")),
        )
    )
    stop = F.filter(
        "_words",
        lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS),
    )
    symbols = F.length(F.translate("_text", "#*$%&|<>", ""))
    return ordered.select(
        "_row",
        F.monotonically_increasing_id().alias("_place"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - symbols).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(
            F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))
        )
        .cast("long")
        .alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )


def _judged(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    broken = [F.when(_broken(r), F.lit(r.name)) for r in rules]
    base = [_broken(r) for r in rules if r.base]
    return (
        _measured(docs, text)
        .withColumn("failed", F.concat_ws(",", *broken))
        .withColumn("base_failed", reduce(lambda a, b: a | b, base, F.lit(False)))
        .withColumn("kept", F.col("failed") == "")
    )


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_row, the measures, failed (names of broken rules, comma-joined), base_failed, kept.

    One row per input row, whatever its id, repeats included. ``_row`` holds all input
    columns, so names that clash with measures do no harm. A null or empty text has no
    words and fails the word count. An empty table gives an empty result.
    """
    return _judged(docs, text, rules).drop("_place")


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns."""
    return _judged(docs, text, rules).where("kept and _place >= 0").select("_row.*")
