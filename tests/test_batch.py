import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import (
    EMBEDDINGS,
    NO_BROADCAST,
    QUERIES,
    SURVEY,
    brute_force,
    plan_of,
    rounded,
)
from respondex.operators import nearest
from respondex.operators.batch import search_batch
from respondex.operators.keys import _sorted_by_range, number_within
from respondex.operators.nearest import _near, nearest_answers
from test_search import people

ASKED = [(1, [0.0, 1.0, 0.0]), (2, [3.0, 3.0, 3.0]), (3, [1.0, 0.5, 2.0])]


@pytest.fixture(scope="module")
def frames(stored):
    survey, vectors = people()
    return (
        stored(survey, SURVEY),
        stored(vectors, EMBEDDINGS),
        stored([*ASKED, (4, None)], QUERIES),
    )


def by_question(found):
    rows = found.orderBy("qid", "result_rank").collect()
    out = {}
    for r in rows:
        row = (r["result_distance"], r["perm"], r["result_question_id"], r["result_text"])
        out.setdefault(r["qid"], []).append(row)
        assert r["result_rank"] == len(out[r["qid"]])
    return {qid: rounded(rows) for qid, rows in out.items()}


def wanted(limit, survey=None, vectors=None):
    if survey is None:
        survey, vectors = people()
    return {qid: rounded(brute_force(survey, vectors, v, limit)) for qid, v in ASKED}


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("limit", [1, 7, 200])
def test_every_question_gets_its_own_search(frames, set_conf, limit, broadcast):
    if not broadcast:
        set_conf(*NO_BROADCAST)
    assert by_question(search_batch(*frames, limit=limit)) == wanted(limit)


def test_many_strangers_fall_back_to_a_plain_join(frames, set_conf, monkeypatch):
    set_conf(*NO_BROADCAST)
    monkeypatch.setattr(nearest, "MAX_BROADCAST_KEYS", 0)
    assert by_question(search_batch(*frames, limit=7)) == wanted(7)


def test_questions_in_blocks(frames):
    _, vectors, queries = frames
    whole = nearest_answers(vectors, queries, 4)
    parts = nearest_answers(vectors, queries, 4, block_bytes=48)
    key = ["qid", "rank", "student_id", "question_id"]
    assert sorted(map(tuple, parts.select(key).collect()), key=str) == sorted(
        map(tuple, whole.select(key).collect()), key=str
    )


def test_qid_must_be_unique(spark, frames):
    twice = spark.createDataFrame([ASKED[0], ASKED[0]], QUERIES)
    with pytest.raises(ValueError, match="qid"):
        search_batch(*frames[:2], twice)


@pytest.mark.parametrize("limit", [0, -1, 1001])
def test_all_rows_for_many_questions(frames, limit):
    assert by_question(search_batch(*frames, limit=limit)) == wanted(limit)


def test_many_questions_take_one_scan(spark, frames, monkeypatch):
    asked = spark.range(20_000).selectExpr("cast(id as int) qid", "array(float(id), 1f, 2f) vector")
    passes = []
    block = nearest._nearest_block
    monkeypatch.setattr(nearest, "_nearest_block", lambda *a: passes.append(1) or block(*a))
    plan = plan_of(nearest_answers(frames[1], asked, 1))
    assert len(passes) == 1 and plan.count("Scan parquet") == 1


def test_no_questions(spark, frames):
    assert search_batch(*frames[:2], spark.createDataFrame([], QUERIES)).collect() == []


def test_pairs_never_become_rows(frames):
    plan = plan_of(search_batch(*frames, limit=2))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def scan(batches, queries, limit):
    """What Spark keeps of the pairs that a task emits."""
    bar, out = np.full(len(queries), np.inf), {}
    for rows in batches:
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows]),
                pa.array([r[1] for r in rows]),
                pa.array([r[2] for r in rows], pa.list_(pa.float32())),
            ],
            names=["student_id", "question_id", "embedding"],
        )
        for at, q, d in _near(batch, queries, limit, bar):
            assert len(at) <= len(rows) * len(queries)
            for i, k, gap in zip(at, q, d.to_pylist()):
                out.setdefault(int(k), []).append((gap, rows[i][0], rows[i][1]))
    return {q: sorted(x)[:limit] for q, x in out.items()}


@pytest.mark.parametrize("dim", [1, 5, 64])
@pytest.mark.parametrize("spread", [1e-6, 1.0, 1e6])
def test_screen_never_loses_a_winner(dim, spread):
    """Far from the origin the matrix product is at its least precise."""
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=dim) * 1e3
    near = (centre + rng.normal(size=(600, dim)) * spread).astype(np.float32)
    near[::3] = near[0]  # a third of all rows are copies
    rows = [(f"s{i:04d}", "r1", v.tolist()) for i, v in enumerate(near)]
    queries = near[[0, 1, 50]].astype(np.float64)
    got = scan([rows[:100], rows[100:350], rows[350:]], queries, 9)
    for q, query in enumerate(queries):
        gaps = np.sqrt(np.add.accumulate((near.astype(np.float64) - query) ** 2, axis=1)[:, -1])
        want = sorted((g, f"s{i:04d}", "r1") for i, g in enumerate(gaps))[:9]
        assert got[q] == want


def test_copies_in_one_batch_are_thinned_out_exactly():
    rows = [(f"s{i:05d}", "r1", [1.0, 2.0]) for i in reversed(range(5000))]
    got = scan([rows], np.array([[1.0, 2.0], [0.0, 0.0]]), 3)
    assert [r[1] for r in got[0]] == ["s00000", "s00001", "s00002"] == [r[1] for r in got[1]]


def test_hot_perm_is_cut_to_what_can_count(stored):
    survey = [("hot", f"a{i % 2}", "b", "c", "d") for i in range(300)]
    survey += [(str(i), "p", "q", "r", "s") for i in range(600)]
    vectors = [("hot", "r1", [0.0, 1.0, 0.0]), ("5", "r2", [0.0, 1.0, 1.0])]
    found = search_batch(
        stored(survey, SURVEY),
        stored(vectors, EMBEDDINGS),
        stored(ASKED, QUERIES),
        limit=301,
    )
    got = by_question(found)
    want = wanted(301, survey, vectors)
    for qid in want:
        assert [r[:3] for r in got[qid]] == [r[:3] for r in want[qid]]


def test_all_rows_of_a_question_lie_in_many_tasks(stored, set_conf):
    """A third of the rows is of one group, and still no window holds it."""
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else str(i % 5), rng.randrange(50), i) for i in range(3000)]
    frame = stored(rows, "g string, d int, i int").repartition(6)
    order = [F.col("d").asc_nulls_last(), F.col("i").asc_nulls_last()]
    found = number_within(frame, "g", order)
    assert "Window" not in plan_of(found).split("FileScan")[0].split("SortMergeJoin")[0]
    got = {(r["g"], r["i"]): r["rank"] for r in found.collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((d, i) for h, d, i in rows if h == g)
        assert [got[g, i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    set_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sorted_rows = _sorted_by_range(frame, [F.asc_nulls_first("g"), *order])
    assert sorted_rows.where("g = 'hot'").select("_part").distinct().count() > 1
    again = number_within(frame, "g", order)
    assert {(r["g"], r["i"]): r["rank"] for r in again.collect()} == got


def test_no_rows_to_number(spark, stored):
    assert number_within(stored([], "g string, d int"), "g", [F.col("d").asc()]).count() == 0


@pytest.mark.parametrize("limit", [0, 20_000])
def test_texts_are_not_sorted_with_all_results(stored, monkeypatch, limit):
    survey = [("a", "x", None, "z", None), ("a", "w", "y", None, None), (None, "v", None, None, None), ("b", "u", None, None, "t")]
    vectors = [("a", "r1", [1.0, 0.0, 0.0]), ("a", "r2", [1.0, 0.0, 0.0]), ("b", "r4", [0.0, 2.0, 0.0])]
    sorted_columns = []

    def spy(rows, order):
        sorted_columns.append(set(rows.columns))
        return _sorted_by_range(rows, order)

    monkeypatch.setattr("respondex.operators.keys._sorted_by_range", spy)
    found = search_batch(
        stored(survey, SURVEY), stored(vectors, EMBEDDINGS), stored(ASKED, QUERIES), limit=limit
    )
    with_qid = [columns for columns in sorted_columns if "qid" in columns]
    assert with_qid and not any({"r1", "r2", "r3", "r4"} & columns for columns in with_qid)
    # Copies of a perm follow one another by their columns, after the question.
    for qid, _ in ASKED:
        rows = found.where(f"qid = {qid}").orderBy("result_rank").collect()
        assert [r["result_rank"] for r in rows] == list(range(1, 7))
        first = [(r["perm"], r["result_question_id"], r["r1"], r["result_text"]) for r in rows]
        of_a = [("a", "r1", "w", "w"), ("a", "r1", "x", "x"), ("a", "r2", "w", "y"), ("a", "r2", "x", None)]
        assert [r for r in first if r[0] == "a"] == of_a
        assert first[-1] == (None, None, "v", None) and ("b", "r4", "u", "t") in first
    assert "r3" not in plan_of(found.select("qid", "result_rank", "perm", "result_distance"))
