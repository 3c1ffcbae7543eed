import hashlib
import os
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from helpers import EMBEDDINGS, NO_BROADCAST, plan_of
from respondex.operators import embed as job
from respondex.models import MODELS, Model, _count_words, model, word_count_model
from respondex.operators.embed import (
    EmbeddingStore,
    embed_column,
    embed_distinct,
    embed_queries,
    embed_texts,
)
from respondex.session import write_record
from respondex.sources import embeddings as sink
from respondex.sources.embeddings import (
    export_embeddings,
    export_join,
    materialize_if_absent,
    model_embeddings,
    read_embeddings,
)

TEXTS = "student_id string, question_id string, text string"


def lengths(dim=2):
    """A model that gives (length, 1) and refuses some texts."""

    def load():
        def embed(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return [None if "none" in t else [float(len(t)), 1.0] for t in texts]

        return embed

    return Model("lengths", dim, load=load, batch_size=3)


def sample(n=50):
    return [(str(i), "r1", "x" * (i + 1)) for i in range(n)]


def vectors_of(store):
    return {r["student_id"]: r["embedding"] for r in store.embeddings().collect()}


def test_vectors_come_back_with_their_row(stored):
    rows = embed_texts(stored(sample(), TEXTS), lengths()).collect()
    assert {r["student_id"]: r["embedding"] for r in rows} == {
        str(i): [i + 1.0, 1.0] for i in range(50)
    }
    assert all(r["error"] is None for r in rows)


def test_one_bad_text_does_not_spoil_its_batch(stored):
    texts = ["ab", "boom", "none", None, ""]
    rows = stored([(str(i), "r1", text) for i, text in enumerate(texts, 1)], TEXTS)
    found = embed_texts(rows, lengths()).collect()
    got = {r["student_id"]: (r["embedding"], r["error"]) for r in found}
    assert got["1"] == ([2.0, 1.0], None) and got["5"] == ([0.0, 1.0], None)
    assert got["2"] == (None, "RuntimeError: boom")
    assert got["3"] == (None, "the model returned nothing")
    assert got["4"] == (None, "text is NULL")


@pytest.mark.parametrize(
    "output,reason", [([1.0], "shape"), ([1.0, float("nan")], "finite"), ([[1.0], [2.0]], "shape")]
)
def test_odd_model_output_is_an_error(stored, output, reason):
    odd = Model("odd", 2, load=lambda: lambda texts: [output for _ in texts])
    row = embed_texts(stored([("1", "r1", "x")], TEXTS), odd).first()
    assert row["embedding"] is None and reason in row["error"]


def test_normalized_model(stored):
    unit = Model("unit", 2, normalize=True, load=lambda: lambda t: [[3.0, 4.0] for _ in t])
    row = embed_texts(stored([("1", "r1", "x")], TEXTS), unit).first()
    assert row["embedding"] == pytest.approx([0.6, 0.8])


def test_prefix_goes_on_questions_only(stored):
    asked = Model("asked", 2, query_prefix="12345", load=lengths().load)
    row = embed_queries(stored([(1, "abc")], "qid int, text string"), asked).first()
    assert row["vector"] == [8.0, 1.0] and row["text"] == "abc"
    row = embed_texts(stored([("1", "r1", "abc")], TEXTS), asked).first()
    assert row["embedding"] == [3.0, 1.0]


def test_registry():
    assert [(m.dim, m.normalize) for m in map(model, ("mxbai", "mxbai_norm", "openai"))] == [
        (1024, False), (1024, True), (1536, False),
    ]
    assert MODELS["openai"].query_prefix == "" and MODELS["mxbai"].query_prefix.endswith(": ")
    with pytest.raises(ValueError, match="unknown model"):
        model("openal")
    with pytest.raises(ValueError, match="no embedding function"):
        embed_column(None, model("openai"))


def test_stand_in_counts_words(stored):
    rows = stored([("1", "r1", "The cat, the DOG; 7 the")], TEXTS)
    row = embed_texts(rows, word_count_model(32)).first()
    assert sum(row["embedding"]) == 5 and max(row["embedding"]) >= 3


@pytest.mark.parametrize("batches", [1, 4])
def test_second_run_adds_nothing(spark, stored, tmp_path, batches):
    texts = stored(sample(), TEXTS)
    store = EmbeddingStore(spark, f"{tmp_path}/store")
    assert store.embeddings().count() == 0
    assert store.add_pending(texts, lengths(), batches=batches, files_per_batch=2)
    assert store.add_pending(texts, lengths(), batches=batches, files_per_batch=2) is None
    assert store.embeddings().count() == 50
    assert vectors_of(store)["9"] == [10.0, 1.0]


@pytest.mark.parametrize("bound", [0, 10])
def test_a_few_new_texts_are_found_by_key(stored, monkeypatch, bound):
    monkeypatch.setattr(job, "MAX_BROADCAST_KEYS", bound)
    done = stored(sample(48), TEXTS)
    found = job.pending_rows(stored(sample(), TEXTS), done)
    assert sorted(r["student_id"] for r in found.collect()) == ["48", "49"]
    assert job.pending_rows(done, stored(sample(), TEXTS)) is None


def test_failed_texts_stay_pending(spark, stored, tmp_path):
    texts = stored([("1", "r1", "ok"), ("2", "r1", "boom")], TEXTS)
    store = EmbeddingStore(spark, f"{tmp_path}/store")
    store.add_pending(texts, lengths())
    assert vectors_of(store).keys() == {"1"}
    assert [r["student_id"] for r in store.failures().collect()] == ["2"]
    store.add_pending(texts, Model("calm", 2, load=lambda: lambda t: [[7.0, 7.0] for _ in t]))
    assert vectors_of(store) == {"1": [2.0, 1.0], "2": [7.0, 7.0]}


def test_finished_batches_survive_a_crash(spark, stored, tmp_path, monkeypatch):
    texts = stored(sample(), TEXTS)
    store = EmbeddingStore(spark, f"{tmp_path}/store")
    write = EmbeddingStore._write
    done = []

    def failing(self, *args):
        if len(done) == 2:
            raise RuntimeError("lost")
        write(self, *args)
        done.append(args)

    monkeypatch.setattr(EmbeddingStore, "_write", failing)
    with pytest.raises(RuntimeError, match="lost"):
        store.add_pending(texts, lengths(), batches=4)
    kept = store.embeddings().count()
    assert 0 < kept < 50
    monkeypatch.setattr(EmbeddingStore, "_write", write)
    store.add_pending(texts, lengths(), batches=4)
    assert store.embeddings().count() == 50 == len(vectors_of(store))


def test_half_written_batch_does_not_count(spark, stored, tmp_path):
    store = EmbeddingStore(spark, f"{tmp_path}/store")
    store.add_pending(stored(sample(), TEXTS), lengths())
    next((tmp_path / "store" / "done").glob("*-0")).unlink()
    assert store.embeddings().count() == 0


def test_finished_work_counts_without_markers(spark, stored, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store = EmbeddingStore(spark, f"{tmp_path}/store")
        texts = stored(sample(), TEXTS)
        store.add_pending(texts, lengths())
        assert store.embeddings().count() > 0
        before = store.failures().count()
        store.add_pending(texts, lengths())
        assert len(vectors_of(store)) == store.embeddings().count()
        assert store.failures().count() >= before
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_key_lookup_reads_no_vectors(spark, stored, tmp_path):
    store = EmbeddingStore(spark, f"{tmp_path}/store")
    store.add_pending(stored(sample(), TEXTS), lengths())
    plan = plan_of(store.keys())
    assert "embedding" not in plan.split("ReadSchema")[1]
    assert "PartitionFilters: [isnotnull(status" in plan


def test_export_keeps_texts_without_vector(spark, stored, tmp_path, set_conf, monkeypatch):
    texts = stored([("1", "r1", "a"), ("2", "r1", "b")], TEXTS)
    vectors = stored([("1", "r1", [1.0]), ("9", "r1", [2.0]), (None, "r1", [3.0])], EMBEDDINGS)
    want = [("1", "r1", [1.0]), ("2", "r1", None)]
    assert sorted(map(tuple, export_join(texts, vectors).collect())) == want
    for bound in (1000, 0):
        monkeypatch.setattr(sink, "MAX_BROADCAST_KEYS", bound)
        for _ in range(2):
            export_embeddings(texts, vectors, f"{tmp_path}/export")
        got = read_embeddings(spark, f"{tmp_path}/export")
        assert got.columns == ["student_id", "question_id", "embedding"]
        assert sorted(map(tuple, got.collect())) == want


def test_export_moves_no_vectors(stored, set_conf):
    set_conf(*NO_BROADCAST)
    set_conf("spark.sql.adaptive.enabled", "false")
    texts = stored([("1", "r1", "a"), ("2", "r1", "b")], TEXTS)
    vectors = stored([("1", "r1", [1.0])], EMBEDDINGS)
    lines = plan_of(sink.export_rows(texts, vectors)).splitlines()
    for above, below in zip(lines, lines[1:]):
        assert not ("Exchange" in above and "embedding" in below)


def test_columns_are_picked_by_name(spark, tmp_path):
    schema = "embedding array<double>, question_id string, student_id int"
    spark.createDataFrame([([1.5], "r1", 7)], schema).write.parquet(f"{tmp_path}/e")
    assert tuple(read_embeddings(spark, f"{tmp_path}/e").first()) == ("7", "r1", [1.5])


def test_model_vectors_are_copied_on_first_use(spark, stored, tmp_path):
    source = f"{tmp_path}/source"
    stored([("1", "r1", [1.0])], EMBEDDINGS).write.parquet(source)
    remote = lengths().using(source=source)
    assert model_embeddings(spark, remote, str(tmp_path)).count() == 1
    assert model_embeddings(spark, lengths(), str(tmp_path)).count() == 1


def test_copy_is_made_once_and_never_touched(spark, tmp_path):
    source, copy = f"{tmp_path}/source", f"{tmp_path}/copy"
    spark.range(3).write.parquet(source)
    assert materialize_if_absent(spark, source, copy).count() == 3
    spark.range(5).write.mode("overwrite").parquet(source)
    assert materialize_if_absent(spark, source, copy).count() == 3
    (tmp_path / "copy" / "_SUCCESS").unlink()
    assert materialize_if_absent(spark, source, copy).count() == 3
    single = next((tmp_path / "source").glob("*.parquet")).rename(tmp_path / "single.parquet")
    before = single.read_bytes()
    materialize_if_absent(spark, copy, str(single)).count()
    assert single.read_bytes() == before


def counting(path, dim=2):
    """A model that notes every text it is called with."""

    def load():
        def embed(texts):
            with open(f"{path}/{os.getpid()}", "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return [None if "none" in t else [float(len(t)), 1.0] for t in texts]

        return embed

    return Model("counting", dim, load=load)


def calls(path):
    return Counter(line for f in path.iterdir() for line in f.read_text().splitlines())


@pytest.mark.parametrize("copy_rows", [1 << 16, 7])
@pytest.mark.parametrize("batches", [1, 3])
def test_each_text_is_embedded_once(spark, stored, tmp_path, monkeypatch, batches, copy_rows):
    monkeypatch.setattr(job, "_COPY_ROWS", copy_rows)
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = [(str(i), "r1", "N/A") for i in range(100)]
    rows += [(str(i), "r2", f"text {i % 40}") for i in range(100)] + [(str(i), "r3", "none") for i in range(5)]
    rows += [("x", "r1", "single")]
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    store.add_pending(stored(rows, TEXTS), counting(seen), batches=batches)
    assert calls(seen) == Counter({"N/A", "none", "single"} | {f"text {i}" for i in range(40)})
    got = {(r["student_id"], r["question_id"]): r["embedding"] for r in store.embeddings().collect()}
    assert got == {(s, q): [float(len(t)), 1.0] for s, q, t in rows if t != "none"}
    assert store.failures().count() == 5
    assert store.add_pending(stored(rows[:200], TEXTS), counting(seen)) is None


def test_distinct_texts_of_nothing_and_nulls(spark, stored):
    rows = stored([("1", "r1", None), ("2", "r1", None), ("3", "r1", ""), ("4", "r1", "")], TEXTS)
    found = {r["student_id"]: r for r in embed_distinct(rows, lengths()).collect()}
    assert {s: r["error"] for s, r in found.items()} == {"1": "text is NULL", "2": "text is NULL", "3": None, "4": None}
    assert found["3"]["text_hash"] == found["4"]["text_hash"] and found["1"]["text_hash"] is None
    assert embed_distinct(rows.where("false"), lengths()).count() == 0


def test_edited_answers_get_a_new_vector(spark, stored, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    model = counting(seen)
    first = [("1", "r1", "aa"), ("2", "r1", "bbb"), ("3", "r1", "c")]
    store.add_pending(stored(first, TEXTS), model)
    edited = [("1", "r1", "aa"), ("2", "r1", "bbbbbb"), ("3", "r1", "c"), ("4", "r1", "new")]
    assert store.add_pending(stored(edited[:3], TEXTS), model) is None
    assert vectors_of(store)["2"] == [3.0, 1.0]
    store.add_pending(stored(edited, TEXTS), model, refresh=True)
    assert vectors_of(store) == {"1": [2.0, 1.0], "2": [6.0, 1.0], "3": [1.0, 1.0], "4": [3.0, 1.0]}
    assert calls(seen) == Counter(["aa", "bbb", "c", "bbbbbb", "new"])
    assert store.add_pending(stored(edited, TEXTS), model, refresh=True) is None
    # An edit that can't be embedded leaves the old vector, and is tried again.
    store.add_pending(stored([("1", "r1", "none")], TEXTS), model, refresh=True)
    assert vectors_of(store)["1"] == [2.0, 1.0] and store.failures().count() == 1
    store.add_pending(stored([("2", "r1", "b")], TEXTS), model, refresh=True)
    assert vectors_of(store)["2"] == [1.0, 1.0] and store.embeddings().count() == 4


def test_vectors_without_a_hash_count_as_right(spark, stored, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    rows = embed_texts(stored([("1", "r1", "aa")], TEXTS), lengths())
    store._save(rows, "1", 0)
    write_record(spark, f"{store.path}/done/1-0")
    assert store.add_pending(stored([("1", "r1", "other")], TEXTS), lengths(), refresh=True) is None
    assert vectors_of(store) == {"1": [2.0, 1.0]}


def test_compaction(spark, stored, tmp_path, monkeypatch):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    rows = sample(30) + [("bad", "r1", "none")]
    assert store.compact() is None
    store.add_pending(stored(rows[:20], TEXTS), lengths(), batches=4)
    store.add_pending(stored(rows, TEXTS), lengths(), batches=4)
    store.add_pending(stored([("3", "r1", "longer than before")], TEXTS), lengths(), refresh=True)
    before, failed = vectors_of(store), sorted(map(tuple, store.failures().collect()))
    assert len(store.records()) == 9 and before["3"] == [18.0, 1.0] and len(failed) == 1
    old = store.embeddings()

    def cut_off(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(job, "write_record", cut_off)
        with pytest.raises(RuntimeError, match="cut off"):
            store.compact()
    assert len(store.records()) == 9 and vectors_of(store) == before
    store.compact()
    assert len(store.records()) == 1 and vectors_of(store) == before
    assert sorted(map(tuple, store.failures().collect())) == failed
    assert {r["student_id"]: r["embedding"] for r in old.collect()} == before
    data = len(list((tmp_path / "store").rglob("*.parquet")))
    store.clean()
    assert vectors_of(store) == before and len(list((tmp_path / "store").rglob("*.parquet"))) < data
    assert len(store._stored("ok").inputFiles()) <= 2
    # Later runs go on from the compacted state.
    store.add_pending(stored([("4", "r1", "edited"), ("new", "r1", "ab")], TEXTS), lengths(), refresh=True)
    assert vectors_of(store) == before | {"4": [6.0, 1.0], "new": [2.0, 1.0]}
    assert store.compact() and vectors_of(store)["4"] == [6.0, 1.0]


def test_a_failed_export_leaves_the_old_one(spark, stored, tmp_path):
    path = str(tmp_path / "export")
    texts = stored([("1", "r1", "a"), ("2", "r1", "b")], TEXTS)
    export_embeddings(texts, stored([("1", "r1", [1.0])], EMBEDDINGS), path)
    bad = stored([("1", "r1", [2.0])], EMBEDDINGS)
    broken = bad.withColumn("embedding", F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast("array<float>")))
    with pytest.raises(Exception, match="lost"):
        export_embeddings(texts, broken, path)
    got = {r["student_id"]: r["embedding"] for r in read_embeddings(spark, path).collect()}
    assert got == {"1": [1.0], "2": None}
    export_embeddings(texts, bad, path)
    got = {r["student_id"]: r["embedding"] for r in read_embeddings(spark, path).collect()}
    assert got == {"1": [2.0], "2": None}
    assert not list(tmp_path.glob("export.old*"))


def test_word_counts_of_awkward_texts():
    texts = ["", "a\0b", "\0", "é漢 x𝒳y \U0001f600z", "  ", "1a2", "ß İ", "It's", "a" * 5000]
    got = _count_words(64)(texts)
    for row, text in zip(got, texts):
        want = [0.0] * 64
        for word in regex.findall(r"\p{L}+", text):
            want[int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % 64] += 1
        assert row.tolist() == want
    assert _count_words(64)([]).shape == (0, 64)
