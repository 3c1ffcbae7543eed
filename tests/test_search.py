import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import (
    EMBEDDINGS,
    NO_BROADCAST,
    SURVEY,
    brute_force,
    plan_of,
    result_rows,
    rounded,
)
from respondex.operators import search as search_module
from respondex.operators.search import search

QUERY = [0.0, 1.0, 0.0]


def people(n=40, seed=3):
    """Survey rows and vectors with every awkward case in them."""
    rng = random.Random(seed)
    survey, vectors = [], []
    for i in range(n):
        perm = str(i)
        survey.append((perm, *[f"{perm}/{q}" for q in range(1, 5)]))
        for q in rng.sample(range(1, 5), rng.randint(0, 4)):
            vector = [float(rng.randint(0, 3)) for _ in range(3)]
            if rng.random() < 0.08:
                vector = None
            elif rng.random() < 0.08:
                vector = [float("nan"), 0.0, 0.0]
            vectors.append((perm, f"r{q}", vector))
    survey += [survey[4], survey[4], (None, "n1", "n2", "n3", "n4"), ("x", *["y"] * 4)]
    vectors += [("stranger", "r1", QUERY), (None, "r2", QUERY), vectors[0]]
    return survey, vectors


@pytest.fixture(scope="module")
def frames(stored):
    survey, vectors = people()
    return stored(survey, SURVEY), stored(vectors, EMBEDDINGS)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("route", ["direct", "narrow"])
@pytest.mark.parametrize("limit", [1, 10, 45, 500])
def test_top_k_equals_brute_force(frames, set_conf, route, limit, broadcast):
    if not broadcast:
        set_conf(*NO_BROADCAST)
    found = search(*frames, QUERY, limit=limit, route=route)
    assert result_rows(found) == rounded(brute_force(*people(), QUERY, limit))


@pytest.mark.parametrize("limit", [0, -1])
def test_no_limit_means_all(frames, limit):
    got = result_rows(search(*frames, QUERY, limit=limit))
    want = rounded(brute_force(*people(), QUERY, 0))
    assert got == want


def test_prefilter_drops_the_nearest(frames):
    survey, vectors = people()
    few = [p for p in survey if p[0] is not None and p[0].endswith("7")]
    found = search(frames[0].filter(F.col("perm").endswith("7")), frames[1], QUERY, limit=5)
    assert result_rows(found) == rounded(brute_force(few, vectors, QUERY, 5))


def test_result_has_all_survey_columns_in_order(frames):
    survey = frames[0].withColumn("DEPT0", F.lit("X"))
    found = search(survey, frames[1], QUERY, limit=3)
    assert found.columns == [
        "perm", "r1", "r2", "r3", "r4", "DEPT0", "embedding",
        "result_question_id", "result_distance", "result_text",
    ]
    assert "embedding" not in search(survey, frames[1], QUERY, include_embedding=False).columns


def test_number_perm_still_joins(spark, frames):
    survey = spark.createDataFrame([(1, "a", "b", "c", "d")], SURVEY.replace("perm string", "perm bigint"))
    vectors = spark.createDataFrame([("1", "r2", QUERY)], EMBEDDINGS)
    for route in ("direct", "narrow"):
        row = search(survey, vectors, QUERY, limit=5, route=route).collect()[0]
        assert (row["perm"], row["result_text"], row["result_distance"]) == (1, "b", 0.0)


@pytest.mark.parametrize("bad", [[1.0, 2.0], [1.0, None, 2.0]])
def test_faulty_vectors_fail(spark, frames, bad):
    vectors = frames[1].unionByName(spark.createDataFrame([("3", "r1", bad)], EMBEDDINGS))
    for route in ("direct", "narrow"):
        with pytest.raises(Exception, match="vector of length 2|null element"):
            search(frames[0], vectors, QUERY, limit=5, route=route).collect()


def test_unknown_question_id_fails(spark, frames):
    vectors = spark.createDataFrame([("3", "r9", QUERY)], EMBEDDINGS)
    with pytest.raises(PySparkException, match="r9"):
        search(frames[0], vectors, QUERY, limit=1).collect()


def test_wrong_options(frames):
    with pytest.raises(ValueError):
        search(*frames, QUERY, route="fast")
    with pytest.raises(ValueError):
        search(*frames, QUERY, limit=0, route="narrow")


def test_route_follows_the_size(frames, set_conf, monkeypatch):
    direct = plan_of(search(*frames, QUERY, limit=5)).count("TakeOrderedAndProject")
    monkeypatch.setattr(search_module, "DIRECT_INPUT_BYTES", 10)
    assert plan_of(search(*frames, QUERY, limit=5)).count("TakeOrderedAndProject") > direct
    monkeypatch.undo()
    set_conf(*NO_BROADCAST)
    assert plan_of(search(*frames, QUERY, limit=5)).count("TakeOrderedAndProject") > direct


def test_plan_is_a_top_k(frames, set_conf):
    assert "TakeOrderedAndProject" in plan_of(search(*frames, QUERY, limit=5))
    set_conf(*NO_BROADCAST)
    plan = plan_of(search(*frames, QUERY, limit=5, route="narrow"))
    assert plan.count("TakeOrderedAndProject") >= 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_narrow_route_shuffles_neither_answers_nor_vectors(frames, set_conf):
    set_conf(*NO_BROADCAST)
    set_conf("spark.sql.adaptive.enabled", "false")
    found = search(*frames, QUERY, limit=5)
    assert result_rows(found) == rounded(brute_force(*people(), QUERY, 5))
    lines = plan_of(found).splitlines()
    shuffles = [i for i, line in enumerate(lines) if " Exchange hashpartitioning" in line]
    shuffles = [i for i in shuffles if "Reused" not in lines[i]]
    assert shuffles
    for i in shuffles:
        wide = "r1#" in lines[i + 1] or "embedding#" in lines[i + 1]
        assert not wide or "WindowGroupLimit" in lines[i + 1]  # a few rows for each task


def test_hot_student_and_hot_perm(stored, set_conf):
    """A third of all survey rows and of all vectors belong to one key."""
    set_conf(*NO_BROADCAST)
    n = 900
    survey = [("hot" if i % 3 == 0 else str(i), f"a{i}", None, None, None) for i in range(n)]
    vectors = [("hot" if i % 3 == 0 else str(i), "r1", [float(i), 1.0]) for i in range(n)]
    frames = stored(survey, SURVEY), stored(vectors, EMBEDDINGS)
    query = [6.2, 1.0]
    want = rounded(brute_force(survey, vectors, query, 700))
    for route in ("direct", "narrow"):
        got = result_rows(search(*frames, query, limit=700, route=route))
        assert [r[:3] for r in got] == [r[:3] for r in want]


def test_narrow_route_measures_every_vector_once(frames, set_conf):
    """The ranking of students is used twice but computed once."""
    set_conf(*NO_BROADCAST)
    final = plan_of(search(*frames, QUERY, limit=5), executed=True).split("Initial Plan")[0]
    vector_scans = [x for x in final.splitlines() if "FileScan" in x and "embedding#" in x]
    assert len(vector_scans) == 2 and final.count("ReusedExchange") == 1


def test_hot_keys_are_split_when_all_rows_are_wanted(stored, set_conf):
    set_conf(*NO_BROADCAST)
    set_conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
    set_conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    set_conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1KB")
    survey = [(str(i), f"a{i}", None, None, None) for i in range(3000)]
    vectors = [("7" if i % 3 == 0 else str(i), "r1", [float(i), 1.0]) for i in range(3000)]
    found = search(stored(survey, SURVEY), stored(vectors, EMBEDDINGS), [6.2, 1.0], limit=0)
    assert "skew=true" in plan_of(found, executed=True)
    assert found.filter("perm = '7'").count() == 1001
