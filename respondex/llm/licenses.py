"""Licence scan: notice phrases by Aho-Corasick, licence expressions by shunting-yard.

A text becomes its words, in lower case (A-Z) and one blank apart, so a phrase is one string
with a blank at either end, and one pass of the automaton finds every place of every phrase.
Where the identifier tag is among them, the expression after each tag is parsed and
evaluated: ``or`` leaves the choice of the freer licence, ``and`` binds to the stricter,
``with`` adds an exception that halves the restriction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: phrase -> label; words in lower case.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
OWN_PHRASES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "gnu general public license": "gpl",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "no rights reserved": "public-domain",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"

#: label -> restriction, from 0 (free) to 1 (nothing is allowed).
RESTRICTION = {
    "agpl": 0.8,
    "apache": 0.1,
    "bsd": 0.1,
    "cc-by": 0.2,
    "cc-by-nc": 0.8,
    "cc-by-nd": 0.7,
    "cc-by-sa": 0.4,
    "cc0": 0.0,
    "gpl": 0.7,
    "isc": 0.1,
    "lgpl": 0.5,
    "mit": 0.1,
    "mpl": 0.4,
    "public-domain": 0.0,
    "reserved": 1.0,
    "unlicense": 0.0,
}
UNKNOWN = 0.5

_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def _label(identifier: str) -> str:
    """Family of an identifier: ``Apache-2.0`` is apache, ``GPL-3.0-or-later`` is gpl."""
    name = identifier.lower()
    fits = [x for x in RESTRICTION if name == x or name.startswith((x + "-", x + "+"))]
    return max(fits, key=len, default=name)


def evaluate(expression: str) -> tuple[float, list[str]]:
    """Restriction and labels of a licence expression; precedence with, and, or.

    Raises ValueError if it isn't one.
    """
    values: list[float] = []
    waiting: list[str] = []
    labels: list[str] = []

    def apply() -> None:
        sign = waiting.pop()
        if sign == "(" or len(values) < 2:
            raise ValueError(expression)
        right, left = values.pop(), values.pop()
        values.append(
            min(left, right) if sign == "or" else max(left, right) if sign == "and" else left / 2
        )

    operand = False  # whether the last token ended an operand
    for token in _TOKEN.findall(expression):
        sign = token.lower()
        if sign in _RANK:
            if not operand:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[sign]:
                apply()
            waiting.append(sign)
            operand = False
        elif token == ")":
            if not operand:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                raise ValueError(expression)
            waiting.pop()
        elif operand:
            raise ValueError(expression)
        elif token == "(":
            waiting.append(token)
        else:
            if waiting and waiting[-1] == "with":
                values.append(0.0)
            else:
                labels.append(_label(token))
                values.append(RESTRICTION.get(labels[-1], UNKNOWN))
            operand = True
    while waiting:
        apply()
    if len(values) != 1:
        raise ValueError(expression)
    return values[0], labels


def _expressions(raw: bytes) -> tuple[list[str], list[str], list[float]]:
    """Texts, labels and restrictions of the expressions after the tags of a text.

    What isn't an expression counts as the licences that it names, all of them binding.
    """
    texts, labels, scores = [], [], []
    for found in _TAG_LINE.findall(raw):
        text = re.sub(r"\s*(\*/|-->|#}).*$", "", found.decode("utf-8", "replace")).strip()
        try:
            score, own = evaluate(text)
        except ValueError:
            own = [_label(x) for x in _TOKEN.findall(text)]
            own = [x for x in own if x in RESTRICTION]
            score = max((RESTRICTION[x] for x in own), default=0.0)
        texts.append(text)
        labels += own
        scores.append(score)
    return texts, labels, scores


_SPAN = "array<struct<word:int,n_words:int,phrase:string,label:string,base:boolean>>"


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    own: dict[str, str] = OWN_PHRASES,
) -> DataFrame:
    """doc_id, n_words, spans, expressions, labels, score; one row per input row.

    ``spans`` has every place of every phrase, in order of its end, overlaps included.
    ``score`` is the restriction of the strictest notice or expression, 0 if there is none.
    Null and empty texts have no words, empty lists and score 0. Rows that repeat an id are
    scanned each; other columns are not looked at; an empty table gives an empty result.
    """
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.StructType.fromDDL(f"x {_SPAN}")[0].dataType),
            T.StructField("expressions", T.ArrayType(T.StringType())),
            T.StructField("labels", T.ArrayType(T.StringType())),
            T.StructField("score", T.DoubleType()),
        ]
    )
    phrases = [(p, label, False) for p, label in own.items()]
    phrases = [x for x in phrases if x[0] not in base]
    phrases += [(p, label, True) for p, label in base.items()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, (phrase, _, _) in enumerate(phrases):
            automaton.add_word(f" {phrase} ", k)
        automaton.add_word(f" {TAG} ", -1)
        automaton.make_automaton()
        span_type = pa.list_(
            pa.struct(
                [
                    ("word", pa.int32()),
                    ("n_words", pa.int32()),
                    ("phrase", pa.string()),
                    ("label", pa.string()),
                    ("base", pa.bool_()),
                ]
            )
        )
        for batch in batches:
            counts, spans, texts, labels, scores = [], [], [], [], []
            for value in batch.column(1).cast(pa.binary()):
                raw = value.as_py() or b""
                words = raw.translate(_PLAIN).split()
                counts.append(len(words))
                # Phrases are ASCII, so one character a byte will do.
                line = f" {b' '.join(words).decode('latin-1')} "
                found, tagged, at, word = [], False, 0, 0
                hits = [
                    (end - len(phrases[k][0]) - 1 if k >= 0 else 0, k)
                    for end, k in automaton.iter(line)
                ]
                for start, k in sorted(hits):
                    if k < 0:
                        tagged = True
                        continue
                    word += line.count(" ", at, start)
                    at = start
                    phrase, label, is_base = phrases[k]
                    found.append((word, phrase.count(" ") + 1, phrase, label, is_base))
                more = _expressions(raw) if tagged else ([], [], [])
                spans.append(
                    [dict(zip(("word", "n_words", "phrase", "label", "base"), x)) for x in found]
                )
                texts.append(more[0])
                labels.append(sorted({x[3] for x in found} | set(more[1])))
                scores.append(
                    max([RESTRICTION.get(x[3], UNKNOWN) for x in found] + more[2], default=0.0)
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, span_type),
                    pa.array(texts, pa.list_(pa.string())),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "n_words", "spans", "expressions", "labels", "score"],
            )

    return rows.mapInArrow(task, schema)
