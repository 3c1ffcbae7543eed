"""Bucketed tables: the same rows, and no shuffle where they meet."""

import pytest

from helpers import EMBEDDINGS, NO_BROADCAST, SURVEY, plan_of
from respondex.operators.embed import embedded_keys, pending_texts
from respondex.operators.reshape import keep_first
from respondex.operators.search import join_answers
from respondex.sources.colocated import buckets_for, largest_bucket, read_colocated, store_colocated
from respondex.sources.embeddings import export_join

TEXTS = "student_id string, question_id string, text string"


@pytest.fixture
def tables(spark, stored, request, set_conf):
    set_conf(*NO_BROADCAST)
    set_conf("spark.sql.requireAllClusterKeysForCoPartition", "true")
    survey = stored([(str(i), "a", "b", None, "d") for i in range(60)] + [("5", "x", None, None, None)], SURVEY)
    texts = stored([(str(i), q, f"t{i}") for i in range(60) for q in ("r1", "r2")], TEXTS)
    vectors = stored([(str(i), "r1", [float(i), 0.0]) for i in range(0, 80, 2)], EMBEDDINGS)
    plain = {"survey": survey, "texts": texts, "vectors": vectors}
    names = {k: f"{request.node.name}_{k}".lower().replace("[", "_").replace("]", "") for k in plain}
    for k, df in plain.items():
        assert store_colocated(df, names[k], "perm" if k == "survey" else "student_id", 8)
    yield plain, {k: read_colocated(spark, n) for k, n in names.items()}
    for n in names.values():
        spark.sql(f"DROP TABLE {n}")


JOBS = {
    "pending": lambda t: pending_texts(t["texts"], embedded_keys(t["vectors"])),
    "export": lambda t: export_join(t["texts"], t["vectors"]),
    "first": lambda t: keep_first(t["texts"].selectExpr("*", "1 AS round"), ["round"]),
    "search": lambda t: join_answers(t["survey"], t["vectors"]),
}


@pytest.mark.parametrize("job", JOBS)
def test_joins_need_no_exchange(tables, job):
    plain, dealt = tables
    found = JOBS[job](dealt)
    assert "Exchange" in plan_of(JOBS[job](plain)) and "Exchange" not in plan_of(found)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, JOBS[job](plain).collect()), key=str)


def test_a_hot_student_keeps_a_table_from_being_bucketed(spark, stored):
    rows = stored([("hot", "r1", f"t{i}") for i in range(400)] + [(str(i), "r1", "t") for i in range(30)], TEXTS)
    assert largest_bucket(rows, "student_id", 16) > 8
    assert not store_colocated(rows, "hot_texts", "student_id", 16)
    table = read_colocated(spark, "hot_texts")
    assert table.count() == 430
    assert "Bucketed: true" not in table._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.sql("DROP TABLE hot_texts")


def test_sizes(spark, stored):
    empty = stored([], TEXTS)
    assert largest_bucket(empty, "student_id", 4) == 0 and buckets_for(empty) == 1
    assert store_colocated(empty, "no_texts", "student_id", 4)
    assert read_colocated(spark, "no_texts").count() == 0
    spark.sql("DROP TABLE no_texts")
