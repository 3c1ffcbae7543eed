import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import EMBEDDINGS
from respondex.functions.vectors import as_vector, distance_to, l2_distance, l2_normalize
from respondex.operators.keys import vector_faults


def frame(spark, vectors):
    rows = [(str(i), "r1", v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, EMBEDDINGS).orderBy("student_id")


def test_both_distances_agree_to_the_bit(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 37)).astype(np.float32).tolist()
    query = rng.normal(size=37).astype(np.float32).tolist()
    rows = frame(spark, vectors).select(
        distance_to("embedding", query).alias("arrow"),
        l2_distance(F.col("embedding"), F.lit(query).cast("array<float>"), 37).alias("plain"),
    )
    for row in rows.collect():
        assert row["arrow"] == row["plain"]


def test_distance_of_a_vector_to_itself_is_zero_and_null_stays_null(spark):
    rows = frame(spark, [[1.5, 2.5], None]).select(distance_to("embedding", [1.5, 2.5]).alias("d"))
    assert [r["d"] for r in rows.collect()] == [0.0, None]


def test_nan_element_gives_nan(spark):
    row = frame(spark, [[math.nan, 1.0]]).select(distance_to("embedding", [0.0, 0.0])).first()
    assert math.isnan(row[0])


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], [1.0, None]])
def test_faulty_vectors_fail_the_query(spark, bad):
    rows = frame(spark, [[1.0, 2.0], bad])
    with pytest.raises(PySparkException):
        rows.select(distance_to("embedding", [1.0, 2.0])).collect()
    with pytest.raises(PySparkException):
        rows.select(as_vector("embedding", 2)).collect()


def test_faults_are_listed(spark):
    rows = frame(spark, [[1.0, 2.0], [1.0], [1.0, None], None])
    found = {r["student_id"]: (r["length"], r["null_element"]) for r in vector_faults(rows, 2).collect()}
    assert found == {"1": (1, False), "2": (2, True)}


@pytest.mark.parametrize("bad", [[], [math.nan], [math.inf, 1.0], [[1.0]]])
def test_query_vector_is_checked_early(bad):
    with pytest.raises(ValueError):
        distance_to("embedding", bad)


def test_normalize(spark):
    rows = frame(spark, [[3.0, 4.0], [0.0, 0.0], None]).select(l2_normalize(F.col("embedding")).alias("u"))
    got = [r["u"] for r in rows.collect()]
    assert got[0] == pytest.approx([0.6, 0.8])
    assert got[1:] == [[0.0, 0.0], None]
