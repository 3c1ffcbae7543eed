import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from respondex.functions.text import SYSTEM_MESSAGE, cut_distance, fill_template, pick_answer
from respondex.operators.context import build_context, render_prompts, with_messages
from respondex.operators.search import display_lines

RESULTS = (
    "qid int, perm string, result_question_id string, result_distance double, result_text string"
)


def test_distances_are_cut_not_rounded(spark):
    cases = [
        (0.98765, "0.98"), (12.34567, "12.3"), (300.123, "300."), (0.0005, "0.00"), (0.0, "0.0"),
        (math.nan, "nan"), (1.0, "1.0"), (1.5, "1.5"), (10.0, "10.0"), (None, "nan"),
    ]
    rows = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d double")
    got = rows.orderBy("i").select(cut_distance(F.col("d"))).collect()
    assert [r[0] for r in got] == [want for _, want in cases]


def test_display_lines(spark):
    rows = [(1, "7", "r2", 0.5, "near"), (1, "9", "r1", 0.75, "far"), (1, "8", None, None, None)]
    got = display_lines(spark.createDataFrame(rows, RESULTS)).collect()
    assert [r["line"] for r in got] == [
        "(distance: 0.5, perm: 7) near", "(distance: 0.75, perm: 9) far", "(distance: nan, perm: 8) ",
    ]


def test_pick_answer(spark):
    rows = spark.createDataFrame(
        [("a", "b", "r1"), ("a", "b", "r2"), ("a", None, "r2"), ("a", "b", None)],
        "r1 string, r2 string, q string",
    )
    picked = rows.select(pick_answer(F.col("q"), ["r1", "r2"])).collect()
    assert [r[0] for r in picked] == ["a", "b", None, None]
    with pytest.raises(PySparkException, match="no answer column named r2"):
        rows.select(pick_answer(F.col("q"), ["r1"])).collect()


def test_template_text_is_never_scanned_again(spark):
    row = spark.createDataFrame([("I am {question} x {{", "why?")], "context string, question string")
    places = {"context": F.col("context"), "question": F.col("question")}
    filled = row.select(fill_template("{{a}} {context}|{question}|{question}", places)).first()[0]
    assert filled == "{{a}} {context}|{question}|{question}".format(
        context="I am {question} x {{", question="why?"
    )


@pytest.mark.parametrize("bad", ["{other}", "{}", "{context!r}", "{context:>9}", "{context"])
def test_bad_templates_are_refused(spark, bad):
    with pytest.raises(ValueError):
        fill_template(bad, {"context": F.lit("x")})


def test_context_is_in_rank_order_and_skips_missing(spark):
    rows = [
        (1, "3", "r1", 0.5, "third"), (1, "2", "r1", 0.25, "second"), (1, "1", "r2", 0.0, "first"),
        (1, "4", None, None, None), (1, "5", "r1", math.nan, "nan"), (1, "1", "r1", 0.0, "zero"),
        (2, "9", None, None, None),
    ]
    found = spark.createDataFrame(rows, RESULTS).repartition(4)
    got = {r["qid"]: tuple(r)[1:] for r in build_context(found).collect()}
    assert got[1] == ("zero\n\nfirst\n\nsecond\n\nthird\n\nnan", 5, 1)
    assert got[2] == ("", 0, 1)


def test_prompts_and_messages(spark):
    contexts = spark.createDataFrame([(1, "A\n\nB")], "qid int, context string")
    queries = spark.createDataFrame([(1, "why?"), (2, "how?")], "qid int, text string")
    ready = with_messages(render_prompts(contexts, queries, "C={context} Q={question}"))
    rows = {r["qid"]: r for r in ready.collect()}
    assert rows[1]["prompt"] == "C=A\n\nB Q=why?" and rows[2]["prompt"] == "C= Q=how?"
    assert [(m["role"], m["content"]) for m in rows[1]["messages"]] == [
        ("system", SYSTEM_MESSAGE), ("user", "C=A\n\nB Q=why?"),
    ]
