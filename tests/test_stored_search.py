"""Searches that read part of the vectors give the rows of a search over all of them."""

import math
import random

import pytest

from helpers import EMBEDDINGS, QUERIES, SURVEY, plan_of, result_rows
from respondex.operators import cells as by_cell
from respondex.operators import quantised
from respondex.operators.batch import search_batch
from respondex.operators.cells import build_cells, cell_table, cells_needed, search_cells, search_cells_batch
from respondex.operators.quantised import codes, search_quantised, store_quantised, whole_vectors
from respondex.operators.search import search

DIM = 4
QUESTION = [0.5, -0.25, 1.0, 0.0]


def people(n, absent=3):
    rows = [(str(i), f"a{i}", f"b{i}", None, f"d{i}") for i in range(n)]
    return rows + [(f"x{i}", "a", None, None, None) for i in range(absent)] + [("7", "again", "b", "c", "d")]


def clustered(n, seed=1):
    """Vectors about a few centres, with ties, strangers, a missing one and odd ones."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-20, 20) for _ in range(DIM)] for _ in range(12)] + [QUESTION]
    rows = []
    for i in range(n):
        for question in ("r1", "r2", "r4"):
            vector = [x + rng.choice([-0.5, 0.0, 0.5]) for x in rng.choice(centres)]
            rows.append((str(i), question, vector))
    rows[0] = ("0", "r1", None)
    rows[1] = ("0", "r2", [math.nan] * DIM)
    rows[2] = ("0", "r4", [math.inf, 0.0, 0.0, 0.0])
    rows += [("stranger", "r1", QUESTION), ("stranger", "r2", QUESTION[:2]), (None, "r1", QUESTION)]
    return rows


@pytest.fixture(scope="module")
def tables(stored):
    return stored(people(200), SURVEY), stored(clustered(200), EMBEDDINGS)


@pytest.fixture(scope="module")
def cell_path(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    build_cells(tables[1], path, DIM, cell_rows=25)
    return path


@pytest.fixture(scope="module")
def code_path(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("codes") / "store")
    store_quantised(tables[1], path, DIM)
    return path


@pytest.mark.parametrize("limit", [5, 350, 598, 0])
def test_cells_and_codes_give_the_rows_of_a_search(tables, cell_path, code_path, limit):
    survey, vectors = tables
    want = search(survey, vectors, QUESTION, limit=limit)
    for found in (
        search_cells(survey, cell_path, QUESTION, limit=limit),
        search_quantised(survey, code_path, QUESTION, limit=limit),
    ):
        assert found.columns == want.columns
        assert result_rows(found) == result_rows(want)


def test_prefiltered_survey(tables, cell_path, code_path):
    survey, vectors = tables
    some = survey.where("perm in ('3', '150', '7', 'x1')")
    want = result_rows(search(some, vectors, QUESTION, limit=5))
    assert result_rows(search_cells(some, cell_path, QUESTION, limit=5)) == want
    assert result_rows(search_quantised(some, code_path, QUESTION, limit=5)) == want


def test_only_promising_cells_are_read(spark, tables, cell_path):
    survey, vectors = tables
    needed = cells_needed(survey, cell_path, QUESTION, 5)
    table = {r["cell"]: r for r in cell_table(spark, cell_path).collect()}
    assert table[by_cell.ODD]["n"] == 4 and len(table) > 10
    read = sum(table[c]["n"] for c in needed)
    assert read < 0.5 * sum(r["n"] for r in table.values())
    plan = plan_of(search_cells(survey, cell_path, QUESTION, limit=5))
    scan = next(line for line in plan.split("\n") if "PartitionFilters: [cell" in line)
    assert "IN (" in scan and all(f"{c}" in scan for c in needed[:2])


def test_bounds_of_cells_hold(spark, tables, cell_path):
    bounds = by_cell._Bounds(spark, cell_path)
    rng = random.Random(5)
    placed = by_cell.cell_vectors(spark, cell_path).where("cell >= 0").collect()
    number = {c: i for i, c in enumerate(bounds.cells)}
    for _ in range(20):
        asked = [rng.uniform(-25, 25) for _ in range(DIM)]
        low = bounds.least(by_cell.query_vector(asked))
        asked = [float(x) for x in by_cell.query_vector(asked)]
        assert all(math.dist(r["embedding"], asked) >= low[number[r["cell"]]] for r in placed)


def test_few_vectors_are_fetched_in_full(spark, tables, code_path):
    survey, vectors = tables
    near = quantised.candidate_rows(survey, code_path, QUESTION, 5).collect()
    odd = 4  # of searched students, those without a code
    assert 5 <= len(near) - odd + 1 < 60
    total = whole_vectors(spark, code_path)
    assert codes(spark, code_path).count() == total.count() == vectors.count()
    width = codes(spark, code_path).where("code is not null").selectExpr("max(length(code))").first()[0]
    assert width == DIM
    where = {(r["row"], r["part"]) for r in total.select("row", "part").collect()}
    assert {(r["row"], r["part"]) for r in near} <= where


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e30])
def test_bounds_of_codes_hold(spark, stored, tmp_path, scale):
    rng = random.Random(3)
    rows = [(str(i), "r1", [scale * rng.gauss(0, 1) for _ in range(DIM)]) for i in range(300)]
    rows += [("same", "r1", [scale] * DIM), ("zero", "r1", [0.0] * DIM)]
    vectors = stored(rows, EMBEDDINGS)
    store_quantised(vectors, str(tmp_path / "s"), DIM)
    asked = [scale * x for x in QUESTION]
    bound = codes(spark, str(tmp_path / "s")).select("student_id", quantised.bounds_to(asked).alias("b"))
    bounds = {r["student_id"]: r["b"] for r in bound.collect()}
    question = [float(x) for x in quantised.query_vector(asked)]
    for r in vectors.collect():
        exact = math.dist(r["embedding"], question)
        least, most = bounds[r["student_id"]]
        assert least <= exact <= most and most - least <= 0.1 * scale


def test_a_faulty_vector_of_a_searched_student_fails(spark, stored, tables, tmp_path):
    survey, _ = tables
    rows = [r for r in clustered(200) if r[0] != "0"] + [("11", "r3", [1.0])]
    vectors = stored(rows, EMBEDDINGS)
    build_cells(vectors, str(tmp_path / "cells"), DIM, cell_rows=25)
    store_quantised(vectors, str(tmp_path / "codes"), DIM)
    for find, path in ((search_cells, "cells"), (search_quantised, "codes")):
        with pytest.raises(Exception, match="another length"):
            find(survey, str(tmp_path / path), QUESTION, limit=3).collect()
        others = survey.where("perm <> '11'")
        assert find(others, str(tmp_path / path), QUESTION, limit=3).count() == 3


def test_empty_stores(spark, stored, tables, tmp_path):
    survey, _ = tables
    for rows in ([], [("3", "r1", None)]):
        vectors = stored(rows, EMBEDDINGS)
        base = tmp_path / f"n{len(rows)}"
        build_cells(vectors, str(base / "cells"), DIM)
        store_quantised(vectors, str(base / "codes"), DIM)
        want = result_rows(search(survey, vectors, QUESTION, limit=3))
        assert result_rows(search_cells(survey, str(base / "cells"), QUESTION, limit=3)) == want
        assert result_rows(search_quantised(survey, str(base / "codes"), QUESTION, limit=3)) == want


@pytest.mark.parametrize("limit", [7, 599, 0])
def test_many_questions_by_cell(stored, tables, cell_path, limit):
    survey, vectors = tables
    rng = random.Random(9)
    asked = [(i, [rng.uniform(-20, 20) for _ in range(DIM)]) for i in range(6)] + [(9, QUESTION), (10, None)]
    queries = stored(asked, QUERIES)
    columns = ["qid", "result_rank", "perm", "r1", "result_question_id"]
    want = search_batch(survey, vectors, queries, limit=limit).select(*columns)
    found = search_cells_batch(survey, cell_path, queries, limit=limit).select(*columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_questions_and_vectors_never_meet_as_rows(spark, stored, tables, cell_path):
    """Their pairs are as many as both multiplied."""
    queries = stored([(i, [float(i % 40), 0.0, 1.0, -1.0]) for i in range(500)], QUERIES)
    sound = by_cell.cell_vectors(spark, cell_path).where("cell <> -1")
    found = by_cell._nearest_by_cell(sound, queries, 2, cell_path)
    plan = plan_of(found)
    assert "MapInArrow" in plan and "Join" not in plan and "ArrowEvalPython" not in plan
    assert found.count() == 1000


def test_repeated_and_absent_qids_by_cell(stored, tables, cell_path):
    survey, vectors = tables
    queries = stored([(1, QUESTION), (1, QUESTION), (None, QUESTION), (2, QUESTION)], QUERIES)
    found = search_cells_batch(survey, cell_path, queries, limit=3).orderBy("qid", "result_rank")
    got = [(r["qid"], r["perm"], r["result_question_id"]) for r in found.collect()]
    once = search_batch(survey, vectors, queries.where("qid = 2"), limit=3).orderBy("result_rank")
    want = [(r["perm"], r["result_question_id"]) for r in once.collect()]
    # Both rows of a question count for each of them, so the nearest answer comes four times.
    assert got == [(1, *want[0])] * 3 + [(2, *w) for w in want]


def test_equal_vectors_fill_a_cell_of_their_own(spark, stored, tables, tmp_path):
    survey, _ = tables
    rows = [(str(i), "r1", [3.0] * DIM) for i in range(150)]
    rows += [(str(i), "r2", [float(i), 0.0, 0.0, 0.0]) for i in range(150)]
    vectors = stored(rows, EMBEDDINGS)
    build_cells(vectors, str(tmp_path / "cells"), DIM, cell_rows=30)
    for limit in (200,):
        want = result_rows(search(survey, vectors, [3.0] * DIM, limit=limit))
        assert result_rows(search_cells(survey, str(tmp_path / "cells"), [3.0] * DIM, limit=limit)) == want


def test_few_pairs_leave_a_task(spark, stored, tmp_path, monkeypatch):
    """However the vectors of the cells lie: here each batch has some of all cells."""
    rng = random.Random(11)
    rows = [(str(i), "r1", [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    build_cells(stored(rows, EMBEDDINGS), str(tmp_path / "cells"), 8, cell_rows=15)
    queries = stored([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], QUERIES)
    mixed = by_cell.cell_vectors(spark, str(tmp_path / "cells")).where("cell >= 0").repartition(1, "student_id")
    passed, rank = [], by_cell.first_of_each

    def counting(local, *more, **options):
        passed.append(local.count())
        return rank(local, *more, **options)

    monkeypatch.setattr(by_cell, "first_of_each", counting)
    assert by_cell._nearest_by_cell(mixed, queries, 2, str(tmp_path / "cells")).count() == 400
    assert len(passed) == 2 and max(passed) <= 420


def test_centres_lie_among_their_vectors(stored):
    rng = random.Random(12)
    rows = [(str(i), "r1", [rng.gauss(0, 1) for _ in range(DIM)]) for i in range(300)]
    vectors = stored([*rows, *rows[:5]], EMBEDDINGS)
    centres = by_cell._fit(vectors, 60, vectors.count())
    assert 50 <= len(centres) <= 60
    apart = [min(math.dist(r[2], c) for c in centres) for r in rows]
    assert sum(apart) / len(apart) < 0.9
    assert by_cell._fit(vectors.where("false"), 60, 0).size == 0


@pytest.mark.parametrize("about, spread", [(0.0, 1.0), (300.0, 1e-3), (0.0, 1e-20), (1e9, 1e18)])
def test_many_questions_where_single_precision_is_not_enough(spark, stored, tmp_path, about, spread):
    """Vectors far from zero and close together, very short or very long ones, and ties."""
    rng = random.Random(13)
    vector = lambda wide: [about + wide * spread * rng.gauss(0, 1) for _ in range(DIM)]
    some = [vector(1) for _ in range(150)] + [[about] * DIM] * 30
    vectors = stored([(str(i), q, some[i]) for i in range(180) for q in ("r1", "r2")], EMBEDDINGS)
    survey = stored([(str(i), "a", "b", None, None) for i in range(180)], SURVEY)
    asked = [(i, vector(1)) for i in range(30)] + [(30 + i, vector(1e6)) for i in range(5)]
    queries = stored([*asked, (40, [about] * DIM), (41, [3e38, -3e38, 1.0, 0.0]), (42, some[3])], QUERIES)
    build_cells(vectors, str(tmp_path / "cells"), DIM, cell_rows=20)
    columns = ["qid", "result_rank", "perm", "result_question_id", "result_distance"]
    want = search_batch(survey, vectors, queries, limit=4).select(*columns)
    found = search_cells_batch(survey, str(tmp_path / "cells"), queries, limit=4).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
