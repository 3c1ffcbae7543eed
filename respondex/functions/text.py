"""Text columns: answer pick, query prefix, display line, template and messages."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the system message every chat request starts with.
SYSTEM_MESSAGE = "You are a helpful assistant."

CONTEXT_SEPARATOR = "\n\n"

def pick_answer(question_id: Column, questions: Sequence[str], row: str | None = None) -> Column:
    """The value of the column that ``question_id`` names; NULL id gives NULL.

    An id that names none of ``questions`` fails the query. ``row`` is the alias the
    answer columns are under, if any.
    """
    prefix = f"{row}." if row else ""
    picked = F.when(question_id.isNull(), F.lit(None).cast("string"))
    for name in questions:
        picked = picked.when(question_id == name, F.col(f"{prefix}`{name}`"))
    unknown = F.concat(F.lit("no answer column named "), question_id)
    return picked.otherwise(F.raise_error(unknown).cast("string"))


def with_prefix(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text) if prefix else text


def cut_distance(distance: Column) -> Column:
    """The first four characters of the plain decimal form: cut, not rounded.

    NULL and NaN print as ``nan``. Distances under 1e-4 print as ``0.00``.
    """
    plain = F.regexp_replace(F.format_string("%.12f", distance), r"(\.\d+?)0+$", "$1")
    shown = F.when(distance.isNull() | F.isnan(distance), F.lit("nan")).otherwise(plain)
    return F.substring(shown, 1, 4)


def display_line(distance: Column, perm: Column, text: Column) -> Column:
    return F.concat(
        F.lit("(distance: "),
        cut_distance(distance),
        F.lit(", perm: "),
        F.coalesce(perm.cast("string"), F.lit("nan")),
        F.lit(") "),
        F.coalesce(text, F.lit("")),
    )


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places with columns; inserted text is never scanned again.

    Doubled braces stand for one brace. A place without a column, a place nobody named
    or a format instruction is refused before anything runs.
    """
    pieces: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"format instructions are not supported: {{{name}}}")
        if name not in values:
            raise ValueError(f"unknown place in template: {{{name}}}")
        pieces.append(values[name])
    return F.concat(*pieces) if pieces else F.lit("")


def chat_messages(prompt: Column) -> Column:
    """The message list of one chat request: system text, then the prompt."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(SYSTEM_MESSAGE)), message("user", prompt))
