"""Queries of the folder against their SQL, and the pipeline against its parts."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry
import corpus_pipeline
from respondex.llm.oracle import ORACLE
from respondex.llm.queries import QUERIES

from test_near import bag, bag_links, groups, plain_lines
from test_records import check_packing, full_tokenizer

SF = "/root/testdata/sf0.001"


def plain(value):
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted([tuple(map(plain, r)) for r in found], key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_all_queries_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == list(QUERIES)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (0, "", None, "src1", None)], docs.schema)
    docs = docs.union(extra)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        out = stage(spark, docs, SF)
        seen.append(name)
        if name == "packing":
            break
        assert out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        texts = [r.text for r in before]
        got = {r.doc_id: r.text for r in rows}
        if name == "line dedup":
            want = {r.doc_id: t for r, t in zip(before, plain_lines(texts)) if t.strip() or not r.text.strip()}
            assert got == want
        elif name == "near-duplicates":
            heads = set(groups(len(texts), bag_links(texts)))
            assert got == {before[i].doc_id: before[i].text for i in heads}
        elif name == "mixing":
            size = {r.doc_id: len((r.text or "").split()) for r in before}
            own = {r.doc_id: r.text for r in before}
            for r in rows:
                assert r.text in own[r.doc_id] and r.n_chars == len(r.text)
            assert all(sum(len(r.text.split()) for r in rows if r.doc_id == i) <= 2 * n for i, n in size.items())
        else:
            assert all(bag(t) for t in got.values())
    assert seen == [name for name, _ in corpus_pipeline.STAGES] and len(seen) == 5
    # Documents come twice in the mix, so sequences are checked over a number for each row.
    full = full_tokenizer()
    rows = [(i, r.text) for i, r in enumerate(docs.collect())]
    again = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = corpus_pipeline.STAGES[-1][1](spark, again, SF).collect()
    check_packing(pieces, {i: full.encode(t, add_special_tokens=False).ids + [2] for i, t in rows})


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"
