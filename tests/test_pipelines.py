import pytest

from helpers import SURVEY
from respondex.models import RETRIEVAL_PREFIX, word_count_model
from respondex.plans.pipelines import (
    add_texts,
    build,
    prepare_prompt,
    prepare_prompts,
    read_texts,
    search_lines,
    search_question,
    unkeyed_path,
)
from respondex.sources.embeddings import read_embeddings
from respondex.sources.survey import read_survey

WORDS = word_count_model(64, query_prefix=RETRIEVAL_PREFIX)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "survey.csv"
    path.write_text(
        "perm,r1,r2,r3,r4\n"
        '101,"writing is\nfun","I like, commas",,essays\n'
        "102,grammar grammar,,,\n"
        "101,later answer,,now answered,\n"
        ",no key,,,\n"
        "103,,,,\n"
    )
    return str(path)


def test_survey_to_prompts(spark, csv, tmp_path):
    survey = read_survey(spark, csv, source_order=True)
    texts, store, export = (f"{tmp_path}/{n}" for n in ("texts", "store", "export"))
    build(survey, texts, store, export, WORDS, batches=2)
    build(survey, texts, store, export, WORDS)

    stored = spark.read.parquet(texts)
    assert sorted(r["id"] for r in stored.collect()) == [1, 2, 3, 4, 5]
    rows = {(r["student_id"], r["question_id"]): r["text"] for r in stored.collect()}
    assert rows == {
        ("101", "r1"): "writing is\nfun", ("101", "r2"): "I like, commas", ("101", "r4"): "essays",
        ("101", "r3"): "now answered", ("102", "r1"): "grammar grammar",
    }
    vectors = read_embeddings(spark, export)
    assert vectors.count() == 5 and vectors.filter("embedding IS NULL").count() == 0

    frame = survey.drop("source_order")
    found = search_question("grammar grammar", frame, vectors, model=word_count_model(64), limit=1)
    row = found.first()
    assert (row["perm"], row["result_text"], row["result_distance"]) == ("102", "grammar grammar", 0.0)

    lines = search_lines("grammar grammar", frame, vectors, model=word_count_model(64), limit=1)
    assert lines.first()["line"] == "(distance: 0.0, perm: 102) grammar grammar"

    one = prepare_prompt("grammar?", found, "{question}: {context}").first()
    assert one["prompt"] == "grammar?: grammar grammar" == one["messages"][1]["content"]

    asked = spark.createDataFrame([(1, "grammar grammar"), (2, "essays")], "qid int, text string")
    ready = prepare_prompts(asked, frame, vectors, model=word_count_model(64), limit=3,
                            template="{context}|{question}")
    prompts = {r["qid"]: r["prompt"] for r in ready.collect()}
    assert prompts[1].startswith("grammar grammar\n\n") and prompts[1].endswith("|grammar grammar")
    assert prompts[2].startswith("essays\n\n")


def test_rows_without_key_are_put_aside(spark, csv, tmp_path):
    survey = read_survey(spark, csv, source_order=True)
    add_texts(survey, f"{tmp_path}/texts")
    aside = spark.read.parquet(unkeyed_path(f"{tmp_path}/texts")).drop("run")
    assert [tuple(r) for r in aside.collect()] == [(None, "r1", "no key")]
    add_texts(survey, f"{tmp_path}/texts")
    assert spark.read.parquet(f"{tmp_path}/texts").count() == 5


def test_ids_go_on_where_the_last_run_ended(spark, tmp_path):
    def run(rows):
        add_texts(spark.createDataFrame(rows, SURVEY), f"{tmp_path}/texts", order=["perm"])
        return {r["student_id"]: r["id"] for r in read_texts(spark, f"{tmp_path}/texts").collect()}

    assert run([("b", "x", None, None, None), ("c", "y", None, None, None)]) == {"b": 1, "c": 2}
    assert run([("a", "z", None, None, None), ("b", "w", None, None, None)]) == {"b": 1, "c": 2, "a": 3}


def test_a_question_the_model_refuses(spark):
    bad = word_count_model(64).using(lambda: lambda texts: [None for _ in texts])
    survey = spark.createDataFrame([("1", "a", "b", "c", "d")], SURVEY)
    with pytest.raises(RuntimeError, match="could not be embedded"):
        search_question("x", survey, None, model=bad)


def test_unknown_model_name(spark):
    survey = spark.createDataFrame([("1", "a", "b", "c", "d")], SURVEY)
    with pytest.raises(ValueError, match="unknown model"):
        search_question("x", survey, None, model="nope")
