"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.functions.text import with_prefix
from respondex.functions.vectors import as_vector, l2_distance, l2_normalize
from respondex.models import RETRIEVAL_PREFIX, word_count_model
from respondex.operators.batch import search_batch
from respondex.operators.cells import build_cells, search_cells, search_cells_batch
from respondex.operators.context import build_context, render_prompts
from respondex.operators.embed import (
    EmbeddingStore,
    embed_queries,
    embed_texts,
    embedded_keys,
    pending_texts,
)
from respondex.operators.keys import assign_ids, duplicate_keys, orphan_keys, vector_faults
from respondex.operators.quantised import search_quantised, store_quantised
from respondex.operators.reshape import keep_first, new_texts, to_long
from respondex.operators.search import display_lines, join_answers, search
from respondex.plans.pipelines import (
    add_texts,
    build,
    prepare_prompts,
    read_texts,
    search_lines,
    search_question,
    unkeyed_path,
)
from respondex.plans.tables import embeddings, query_vector, survey, table, texts
from respondex.schemas import EMBEDDINGS, QUESTIONS, TEXT_KEY, TEXTS, create_tables
from respondex.session import scratch_path
from respondex.sources.colocated import buckets_for, read_colocated, store_colocated
from respondex.sources.embeddings import (
    export_embeddings,
    export_join,
    materialize_if_absent,
    model_embeddings,
    read_embeddings,
)
from respondex.sources.survey import read_survey, read_survey_split, write_survey

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

DIM = 64
WORDS = word_count_model(DIM, query_prefix=RETRIEVAL_PREFIX)
TEMPLATE = "Q {question}\n{context}"


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _elements(df: DataFrame, vector: Column, *keys: str) -> DataFrame:
    """One row per vector element, so that values compare one by one."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "element")).select(
        *keys, "pos", F.round(F.col("element").cast("double"), 6).alias("element")
    )


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("result_distance", F.round("result_distance", 6))


# Sources and sinks


@query("survey_scan")
def _survey_scan(spark, sf_dir):
    return spark.sql("SELECT * FROM {frame}", frame=survey(spark, sf_dir))


@query("csv_scan")
def _csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_survey(survey(spark, sf_dir), path)
    return read_survey(spark, path, types={"first_gen": "int"})


@query("csv_scan_split")
def _csv_scan_split(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_survey(survey(spark, sf_dir), path)
    return read_survey_split(spark, path, types={"first_gen": "int"})


@query("csv_headers")
def _csv_headers(spark, sf_dir):
    """Two files with the columns in another order."""
    path, rows = scratch_path(spark, "csv"), survey(spark, sf_dir)
    write_survey(rows.filter("first_gen = 0"), f"{path}/a")
    turned = rows.filter("first_gen = 1").select(*reversed(rows.columns))
    write_survey(turned, f"{path}/b")
    return read_survey_split(spark, f"{path}/*", types={"first_gen": "int"})


@query("unkeyed_texts")
def _unkeyed(spark, sf_dir):
    """Answers that a build puts aside, as their students have no key."""
    path = scratch_path(spark, "texts")
    key = F.when(F.col("dept") != "D1", F.col("perm")).alias("perm")
    rows = survey(spark, sf_dir).select(key, *QUESTIONS, F.col("perm").alias("place"))
    add_texts(rows, path, order=["place"])
    return spark.read.schema(TEXTS).parquet(unkeyed_path(path)).select(*TEXTS.fieldNames())


@query("build_pipeline")
def _build(spark, sf_dir):
    """Two runs over survey files, the second with more students, then the export."""
    base, rows = scratch_path(spark, "build"), survey(spark, sf_dir)
    write_survey(rows.filter("first_gen = 0"), f"{base}/csv/a")
    write_survey(rows.filter("first_gen = 1"), f"{base}/csv/b")
    for files in (f"{base}/csv/a", f"{base}/csv/*"):
        found = read_survey(spark, files, source_order=True)
        build(found, f"{base}/texts", f"{base}/store", f"{base}/export", WORDS)
    vectors = read_embeddings(spark, f"{base}/export")
    joined = read_texts(spark, f"{base}/texts").join(vectors, list(TEXT_KEY))
    return _elements(joined, F.col("embedding"), "id", *TEXT_KEY)


@query("embedding_scan")
def _embedding_scan(spark, sf_dir):
    path = scratch_path(spark, "embeddings")
    embeddings(spark, sf_dir).write.parquet(path)
    return _elements(read_embeddings(spark, path), F.col("embedding"), *TEXT_KEY)


@query("materialize_if_absent")
def _materialize_copy(spark, sf_dir):
    source, copy = scratch_path(spark, "source"), scratch_path(spark, "copy")
    embeddings(spark, sf_dir).write.parquet(source)
    materialize_if_absent(spark, source, copy)
    embeddings(spark, sf_dir).limit(0).write.mode("overwrite").parquet(source)
    rows = materialize_if_absent(spark, source, copy)
    return _elements(rows, F.col("embedding"), *TEXT_KEY)


@query("texts_scan")
def _texts_scan(spark, sf_dir):
    return _stored(texts(spark, sf_dir), "texts")


@query("tables_if_absent")
def _tables_if_absent(spark, sf_dir):
    """Tables are made once; making them again leaves what is in them."""
    path = scratch_path(spark, "tables")
    names = [f"{n}_{path[-32:]}" for n in ("texts", "words")]
    for _ in range(2):
        create_tables(spark, path, {names[0]: TEXTS, names[1]: EMBEDDINGS})
        if spark.table(names[0]).isEmpty():
            texts(spark, sf_dir).write.insertInto(names[0])
    return spark.table(names[0])


# Reshaping and keys


@query("texts_long")
def _texts_long(spark, sf_dir):
    return texts(spark, sf_dir)


def _two_rounds(spark, sf_dir) -> DataFrame:
    """The survey, and a second round in which the answers moved on by one column."""
    first = survey(spark, sf_dir).withColumn("round", F.lit(1))
    moved = [F.col(b).alias(a) for a, b in zip(QUESTIONS, QUESTIONS[1:] + QUESTIONS[:1])]
    second = first.select("perm", *moved, "dept", "first_gen", F.lit(2).alias("round"))
    return to_long(first.unionByName(second), keep=["round"])


@query("dedup_first")
def _dedup_first(spark, sf_dir):
    return keep_first(_two_rounds(spark, sf_dir), ["round"])


@query("append_new")
def _append_new(spark, sf_dir):
    stored = to_long(survey(spark, sf_dir))
    return new_texts(keep_first(_two_rounds(spark, sf_dir), ["round"]), stored)


@query("pk_audit")
def _pk_audit(spark, sf_dir):
    keys = texts(spark, sf_dir).select(*TEXT_KEY)
    return duplicate_keys(keys.unionByName(embeddings(spark, sf_dir).select(*TEXT_KEY)))


@query("fk_audit")
def _fk_audit(spark, sf_dir):
    return orphan_keys(_two_rounds(spark, sf_dir), embeddings(spark, sf_dir))


@query("assign_ids")
def _assigned_ids(spark, sf_dir):
    return assign_ids(texts(spark, sf_dir), TEXT_KEY)


# Embedding job


@query("pending_texts")
def _pending(spark, sf_dir):
    done = embedded_keys(embeddings(spark, sf_dir))
    return pending_texts(texts(spark, sf_dir), done)


@query("embed_pending")
def _embed_pending(spark, sf_dir):
    """Embed what the first run left over; a third run then finds nothing to do."""
    rows = _stored(texts(spark, sf_dir), "texts")
    store = EmbeddingStore(spark, scratch_path(spark, "store"))
    started = rows.join(embeddings(spark, sf_dir).select(*TEXT_KEY), list(TEXT_KEY), "left_semi")
    store.add_pending(started, WORDS)
    store.add_pending(rows, WORDS, batches=2)
    store.add_pending(rows, WORDS)
    return _elements(store.embeddings(), F.col("embedding"), *TEXT_KEY)


def _edited(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All answers, and the same with those of one department edited."""
    rows = _stored(texts(spark, sf_dir), "texts")
    later = F.when(F.col("question_id") == "r2", F.concat("text", F.lit(" indeed"))).otherwise(F.col("text"))
    return rows, _stored(rows.withColumn("text", later), "texts")


@query("embed_edited")
def _embed_edited(spark, sf_dir):
    """Answers edited after they were embedded get a new vector, the others keep theirs."""
    before, after = _edited(spark, sf_dir)
    store = EmbeddingStore(spark, scratch_path(spark, "store"))
    store.add_pending(before, WORDS)
    store.add_pending(after, WORDS, refresh=True)
    store.add_pending(after, WORDS, refresh=True)
    return _elements(store.embeddings(), F.col("embedding"), *TEXT_KEY)


@query("embed_compact")
def _embed_compact(spark, sf_dir):
    """``embed_pending``, and then many small batches become one."""
    rows = _stored(texts(spark, sf_dir), "texts")
    store = EmbeddingStore(spark, scratch_path(spark, "store"))
    started = rows.join(embeddings(spark, sf_dir).select(*TEXT_KEY), list(TEXT_KEY), "left_semi")
    store.add_pending(started, WORDS, batches=4)
    store.add_pending(rows, WORDS, batches=4)
    store.compact()
    store.clean()
    return _elements(store.embeddings(), F.col("embedding"), *TEXT_KEY)


@query("embed_documents")
def _embed_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The model costs more than moving the texts to more tasks than files.
    tasks = spark.sparkContext.defaultParallelism
    return _elements(embed_texts(rows, WORDS, partitions=tasks), F.col("embedding"), "doc_id")


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query("embed_queries")
def _embedded_queries(spark, sf_dir):
    return _elements(embed_queries(_questions(spark, sf_dir), WORDS), F.col("vector"), "qid")


@query("query_prefix")
def _query_prefix(spark, sf_dir):
    asked = with_prefix(F.col("text"), RETRIEVAL_PREFIX).alias("asked")
    return _questions(spark, sf_dir).select("qid", asked)


@query("export_join")
def _export_rows_joined(spark, sf_dir):
    rows = export_join(texts(spark, sf_dir), embeddings(spark, sf_dir))
    return rows.select(*TEXT_KEY, F.size("embedding").alias("width"))


@query("export_roundtrip")
def _export_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "export")
    export_embeddings(texts(spark, sf_dir), embeddings(spark, sf_dir), path)
    rows = read_embeddings(spark, path)
    vector = F.coalesce("embedding", F.array(F.lit(None).cast("float")))
    return _elements(rows, vector, *TEXT_KEY)


def _colocated(spark, df: DataFrame, key: str, buckets: int) -> DataFrame:
    path = scratch_path(spark, "colocated")
    name = f"colocated_{path[-32:]}"
    store_colocated(df, name, key, buckets, path)
    return read_colocated(spark, name)


def _colocated_tables(spark, sf_dir) -> list[DataFrame]:
    """Survey, texts and vectors in as many buckets of students."""
    vectors = embeddings(spark, sf_dir)
    n = max(8, buckets_for(vectors))
    tables = {"perm": [survey(spark, sf_dir)], "student_id": [texts(spark, sf_dir), vectors]}
    return [_colocated(spark, df, key, n) for key, dfs in tables.items() for df in dfs]


@query("colocated_pending")
def _colocated_pending(spark, sf_dir):
    """``pending_texts`` without a shuffle."""
    _, rows, vectors = _colocated_tables(spark, sf_dir)
    return pending_texts(rows, embedded_keys(vectors))


@query("colocated_export")
def _colocated_export(spark, sf_dir):
    """``export_join`` without a shuffle."""
    _, rows, vectors = _colocated_tables(spark, sf_dir)
    return export_join(rows, vectors).select(*TEXT_KEY, F.size("embedding").alias("width"))


@query("colocated_search_join")
def _colocated_search_join(spark, sf_dir):
    """``search_join`` without a shuffle."""
    people, _, vectors = _colocated_tables(spark, sf_dir)
    return join_answers(people, vectors).withColumn("embedding", F.size("embedding"))


# Vectors


@query("l2_distance")
def _l2_distance_pairs(spark, sf_dir):
    """Every vector against the next one."""
    left = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    gap = l2_distance(F.col("a"), F.col("b"), DIM)
    return left.join(right, "vec_id").select("vec_id", F.round(gap, 6).alias("distance"))


@query("l2_normalize")
def _l2_normalized(spark, sf_dir):
    counts = embed_texts(texts(spark, sf_dir), WORDS)
    return _elements(counts, l2_normalize(F.col("embedding")), *TEXT_KEY)


@query("vector_length_audit")
def _vector_audit(spark, sf_dir):
    """Faults planted by label: a missing element, a NULL element, or none."""
    vector, label = F.col("embedding"), F.col("label")
    broken = (
        F.when(label % 3 == 0, F.slice(vector, 1, DIM - 1))
        .when(label % 3 == 1, F.concat(F.slice(vector, 1, DIM - 1), F.array(F.lit(None))))
        .otherwise(vector)
    )
    planted = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("student_id"),
        label.cast("string").alias("question_id"),
        broken.alias("embedding"),
    )
    return vector_faults(planted, DIM)


@query("vector_cast")
def _vector_cast(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return _elements(rows, as_vector("embedding", DIM), *TEXT_KEY)


# Search


@query("search_join")
def _search_join(spark, sf_dir):
    rows = join_answers(survey(spark, sf_dir), embeddings(spark, sf_dir))
    return rows.withColumn("embedding", F.size("embedding"))


def _search(spark, sf_dir, rows: DataFrame, **options) -> DataFrame:
    vector = query_vector(spark, sf_dir)
    return _rounded(search(rows, embeddings(spark, sf_dir), vector, **options))


@query("search_topk")
def _search_top(spark, sf_dir):
    found = _search(spark, sf_dir, survey(spark, sf_dir), limit=25)
    keys = ["perm", "result_question_id", "result_distance", "result_text"]
    return _elements(found, F.col("embedding"), *keys)


def _cells(spark, sf_dir) -> str:
    """All given vectors, stored by cell."""
    path = scratch_path(spark, "cells")
    build_cells(embeddings(spark, sf_dir), path, DIM, cell_rows=64)
    return path


@query("search_cells")
def _search_cells(spark, sf_dir):
    """``search_topk`` from the vectors' cells."""
    vector = query_vector(spark, sf_dir)
    found = _rounded(search_cells(survey(spark, sf_dir), _cells(spark, sf_dir), vector, limit=25))
    keys = ["perm", "result_question_id", "result_distance", "result_text"]
    return _elements(found, F.col("embedding"), *keys)


@query("search_cells_batch")
def _search_cells_batch(spark, sf_dir):
    """``search_batch_vectors`` from the vectors' cells."""
    found = search_cells_batch(
        survey(spark, sf_dir), _cells(spark, sf_dir), _vector_questions(spark, sf_dir), limit=3
    )
    return _rounded(found).select(
        "qid", "result_rank", "perm", "result_question_id", "result_distance"
    )


@query("search_quantised")
def _search_quantised(spark, sf_dir):
    """``search_topk`` through 8-bit copies of the vectors."""
    path = scratch_path(spark, "quantised")
    store_quantised(embeddings(spark, sf_dir), path, DIM)
    vector = query_vector(spark, sf_dir)
    found = _rounded(search_quantised(survey(spark, sf_dir), path, vector, limit=25))
    keys = ["perm", "result_question_id", "result_distance", "result_text"]
    return _elements(found, F.col("embedding"), *keys)


@query("search_narrow")
def _search_narrow(spark, sf_dir):
    """The same question by the route for big tables."""
    return _search(
        spark, sf_dir, survey(spark, sf_dir), limit=25, include_embedding=False, route="narrow"
    )


@query("search_all")
def _search_all(spark, sf_dir):
    return _search(spark, sf_dir, survey(spark, sf_dir), limit=0, include_embedding=False)


@query("search_prefilter")
def _search_prefilter(spark, sf_dir):
    some = survey(spark, sf_dir).filter(F.col("dept") == "D1")
    return _search(spark, sf_dir, some, limit=10, include_embedding=False)


@query("search_prefilter_and")
def _search_prefilter_and(spark, sf_dir):
    some = survey(spark, sf_dir).filter((F.col("dept") == "D1") & (F.col("first_gen") == 1))
    return _search(spark, sf_dir, some, limit=10, include_embedding=False)


@query("search_normalized")
def _search_normalized(spark, sf_dir):
    """Word counts of the texts and of the first question, all of length one."""
    unit = word_count_model(DIM, query_prefix=RETRIEVAL_PREFIX, normalize=True)
    vectors = embed_texts(texts(spark, sf_dir), unit).drop("error")
    first = _questions(spark, sf_dir).orderBy("qid").limit(1)
    asked = embed_queries(first, unit).first()["vector"]
    found = search(survey(spark, sf_dir), vectors, asked, limit=10, include_embedding=False)
    return _rounded(found)


def _registered(spark, sf_dir) -> tuple[DataFrame, str]:
    """Vectors of a model as its registry entry gives them, copied on first use, and a question."""
    source, copies = scratch_path(spark, "source"), scratch_path(spark, "copies")
    embed_texts(texts(spark, sf_dir), WORDS).drop("error").write.parquet(source)
    entry = WORDS.using(source=source)
    model_embeddings(spark, entry, copies)
    vectors = model_embeddings(spark, entry, copies)
    asked = _questions(spark, sf_dir).orderBy("qid").first()["text"]
    return vectors, asked


@query("search_question")
def _search_question(spark, sf_dir):
    """A question as text, against a model's own copy of the vectors."""
    vectors, asked = _registered(spark, sf_dir)
    people = survey(spark, sf_dir)
    found = search_question(asked, people, vectors, limit=10, model=WORDS, include_embedding=False)
    return _rounded(found)


@query("search_lines")
def _search_lines(spark, sf_dir):
    vectors, asked = _registered(spark, sf_dir)
    return search_lines(asked, survey(spark, sf_dir), vectors, limit=10, model=WORDS)


@query("search_big_limit")
def _search_big_limit(spark, sf_dir):
    """More rows than one task should merge."""
    return _search(spark, sf_dir, survey(spark, sf_dir), limit=20_000, include_embedding=False)


def _by_routes(spark, rows: DataFrame, vectors: DataFrame, vector: list[float]) -> DataFrame:
    """The same 25 rows by all three ways to search."""
    asked = _stored(
        spark.range(1).select("id", F.lit(vector).cast("array<float>").alias("vector")), "asked"
    ).withColumnRenamed("id", "qid")
    ways = [
        search(rows, vectors, vector, limit=25, include_embedding=False, route=route).withColumn(
            "route", F.lit(route)
        )
        for route in ("direct", "narrow")
    ]
    batch = search_batch(rows, vectors, asked, limit=25).drop("qid", "result_rank")
    both = ways[0].unionByName(ways[1])
    return _rounded(both.unionByName(batch.withColumn("route", F.lit("batch"))))


@query("search_int_key")
def _search_int_key(spark, sf_dir):
    """Keys that are numbers, and vectors that tie: ties go by the key as text."""
    rows = survey(spark, sf_dir).withColumn("perm", F.col("perm").cast("int"))
    number = F.substring("question_id", 2, 1).cast("float")
    tied = embeddings(spark, sf_dir).withColumn("embedding", F.array_repeat(number, DIM))
    return _by_routes(spark, rows, _stored(tied, "vectors"), [1.0] * DIM)


@query("search_repeated_perm")
def _search_repeated_perm(spark, sf_dir):
    """Each student twice, the second time with the answers moved on and one missing."""
    first = survey(spark, sf_dir)
    moved = [F.col(b).alias(a) for a, b in zip(QUESTIONS, QUESTIONS[1:])]
    last = F.lit(None).cast("string").alias(QUESTIONS[-1])
    rows = first.unionByName(first.select("perm", *moved, last, "dept", "first_gen"))
    vectors = _stored(embeddings(spark, sf_dir), "vectors")
    return _by_routes(spark, rows, vectors, query_vector(spark, sf_dir))


@query("search_strangers")
def _search_strangers(spark, sf_dir):
    """Vectors of students outside the survey have no say, faulty ones neither."""
    stranger = F.col("student_id").startswith("v")
    short = F.when(stranger, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    vectors = _stored(embeddings(spark, sf_dir).withColumn("embedding", short), "vectors")
    return _by_routes(spark, survey(spark, sf_dir), vectors, query_vector(spark, sf_dir))


@query("pick_answer")
def _picked_answer(spark, sf_dir):
    found = _search(spark, sf_dir, survey(spark, sf_dir), limit=0, include_embedding=False)
    return found.select("perm", "result_question_id", "result_text")


@query("display_lines")
def _display(spark, sf_dir):
    found = search(
        survey(spark, sf_dir),
        embeddings(spark, sf_dir),
        query_vector(spark, sf_dir),
        limit=25,
        include_embedding=False,
    )
    return display_lines(found)


# Many questions, contexts and prompts


def _word_vectors(spark, sf_dir) -> DataFrame:
    return _stored(embed_texts(texts(spark, sf_dir), WORDS).drop("error"), "vectors")


def _found(spark, sf_dir) -> DataFrame:
    asked = _stored(embed_queries(_questions(spark, sf_dir), WORDS), "questions")
    return search_batch(
        survey(spark, sf_dir), _word_vectors(spark, sf_dir), asked, limit=5
    )


@query("search_batch")
def _search_batch_words(spark, sf_dir):
    return _rounded(_found(spark, sf_dir))


def _vector_questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")
    )


@query("search_batch_vectors")
def _search_batch_vectors(spark, sf_dir):
    """Every given vector is a question of its own."""
    asked = _vector_questions(spark, sf_dir)
    found = search_batch(survey(spark, sf_dir), embeddings(spark, sf_dir), asked, limit=3)
    return _rounded(found).select(
        "qid", "result_rank", "perm", "result_question_id", "result_distance"
    )


def _batch_of(spark, sf_dir, limit: int) -> DataFrame:
    asked = _stored(embed_queries(_questions(spark, sf_dir), WORDS), "questions")
    vectors = _word_vectors(spark, sf_dir)
    found = search_batch(survey(spark, sf_dir), vectors, asked, limit=limit)
    return _rounded(found).select(
        "qid", "result_rank", "perm", "result_question_id", "result_distance"
    )


@query("search_batch_all")
def _search_batch_all(spark, sf_dir):
    return _batch_of(spark, sf_dir, 0)


@query("search_batch_big_limit")
def _search_batch_big_limit(spark, sf_dir):
    return _batch_of(spark, sf_dir, 1500)


@query("search_documents")
def _search_documents(spark, sf_dir):
    """Documents as answers to a single question, searched for every given text."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("perm"), F.col("text").alias("r1")
    )
    answers = to_long(rows, questions=["r1"])
    tasks = spark.sparkContext.defaultParallelism
    vectors = _stored(embed_texts(answers, WORDS, partitions=tasks).drop("error"), "vectors")
    asked = _stored(embed_queries(_questions(spark, sf_dir), WORDS), "questions")
    found = search_batch(rows, vectors, asked, limit=5, questions=["r1"])
    return _rounded(found).select("qid", "result_rank", "perm", "result_distance")


@query("build_context")
def _context(spark, sf_dir):
    return build_context(_found(spark, sf_dir))


@query("render_prompt")
def _prompts(spark, sf_dir):
    contexts = build_context(_found(spark, sf_dir))
    return render_prompts(contexts, _questions(spark, sf_dir), TEMPLATE)


@query("prompt_messages")
def _prompt_messages(spark, sf_dir):
    ready = prepare_prompts(
        _questions(spark, sf_dir),
        survey(spark, sf_dir),
        _word_vectors(spark, sf_dir),
        template=TEMPLATE,
        model=WORDS,
    )
    return ready.select("qid", F.posexplode("messages").alias("pos", "message")).select(
        "qid", "pos", "message.role", "message.content"
    )
