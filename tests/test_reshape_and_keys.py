import pytest

from helpers import EMBEDDINGS, SURVEY, plan_of
from respondex.operators.embed import embedded_keys, pending_texts
from respondex.operators.keys import assign_ids, duplicate_keys, orphan_keys
from respondex.operators.reshape import keep_first, new_texts, split_null_keys, to_long
from respondex.schemas import create_tables

TEXTS = "student_id string, question_id string, text string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_answers_give_no_row_and_extra_columns_ride_along(spark):
    survey = spark.createDataFrame(
        [("101", "a1", "a2", None, "a4", 7), ("103", None, None, None, None, 8)],
        SURVEY + ", place int",
    )
    assert rows_of(to_long(survey, keep=["place"])) == [
        ("101", "r1", "a1", 7),
        ("101", "r2", "a2", 7),
        ("101", "r4", "a4", 7),
    ]
    assert "Exchange" not in plan_of(to_long(survey))


def test_number_keys_become_text(spark):
    survey = spark.createDataFrame([(5, "x", None, None, None)], SURVEY.replace("perm string", "perm bigint"))
    assert rows_of(to_long(survey)) == [("5", "r1", "x")]


def test_first_answer_in_source_order_wins(spark):
    survey = spark.createDataFrame(
        [("101", None, "old", "x", None, 1), ("101", "new", "newer", None, None, 2)],
        SURVEY + ", place int",
    )
    kept = keep_first(to_long(survey, keep=["place"]), ["place"])
    assert rows_of(kept) == [("101", "r1", "new"), ("101", "r2", "old"), ("101", "r3", "x")]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    hot = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) student_id", "'r1' question_id",
        "concat('t', id) text", "id place",
    )
    kept = keep_first(hot, ["place"])
    assert kept.count() == 20_000 - 6666
    assert kept.filter("student_id = 'hot'").collect()[0]["text"] == "t0"
    plan = plan_of(kept)
    assert "partial_min" in plan and plan.count("Exchange") == 1


def test_rows_without_a_key_are_set_apart(spark):
    texts = spark.createDataFrame([(None, "r1", "a"), (None, "r1", "b"), ("1", "r1", "c")], TEXTS)
    keyed, unkeyed = split_null_keys(texts)
    assert rows_of(keyed) == [("1", "r1", "c")]
    assert unkeyed.count() == 2


def test_stored_texts_stay(spark):
    stored = spark.createDataFrame([("1", "r1", "old")], TEXTS)
    texts = spark.createDataFrame([("1", "r1", "edited"), ("1", "r2", "more")], TEXTS)
    assert rows_of(new_texts(texts, stored)) == [("1", "r2", "more")]


def test_key_audits(spark):
    texts = spark.createDataFrame([("1", "r1", "a"), ("1", "r1", "b"), ("2", "r1", "c")], TEXTS)
    assert rows_of(duplicate_keys(texts)) == [("1", "r1", 2)]
    parent = spark.createDataFrame([("2", "r1", "c")], TEXTS)
    assert rows_of(orphan_keys(texts, parent)) == [("1", "r1", 2)]


def test_pending_includes_null_vectors(spark):
    texts = spark.createDataFrame([("1", "r1", "a"), ("2", "r1", "b"), ("3", "r1", "c")], TEXTS)
    stored = spark.createDataFrame([("1", "r1", [1.0]), ("2", "r1", None)], EMBEDDINGS)
    pending = pending_texts(texts, embedded_keys(stored))
    assert rows_of(pending) == [("2", "r1", "b"), ("3", "r1", "c")]
    assert "LeftAnti" in plan_of(pending)


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_ids_follow_the_order_without_gaps(spark, set_conf, partitions):
    set_conf("spark.sql.shuffle.partitions", partitions)
    rows = spark.range(5000).selectExpr(
        "cast(id * 7919 % 5000 as string) student_id", "'r1' question_id"
    )
    got = [tuple(r) for r in assign_ids(rows, ["student_id", "question_id"]).orderBy("id").collect()]
    want = sorted(str(i) for i in range(5000))
    assert got == [(n, s, "r1") for n, s in enumerate(want, 1)]


def test_ids_use_many_partitions(spark, set_conf):
    set_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(5000).selectExpr("cast(id as string) student_id", "'r1' question_id")
    numbered = assign_ids(rows, ["student_id", "question_id"])
    assert numbered.rdd.getNumPartitions() > 1


def test_tables_are_created_once(spark, tmp_path):
    for _ in range(2):
        names = create_tables(spark, str(tmp_path), ["openai"])
    assert names == ["texts", "embeddings_openai"]
    spark.createDataFrame([("1", "r1", "a")], TEXTS).write.insertInto("texts")
    create_tables(spark, str(tmp_path), ["openai"])
    assert spark.table("texts").count() == 1
    assert spark.table("embeddings_openai").schema["embedding"].dataType.simpleString() == "array<float>"
