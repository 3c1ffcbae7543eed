"""Whole jobs: build texts and vectors, search, and prepare prompts."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.models import Model, model
from respondex.operators.batch import search_batch
from respondex.operators.context import build_context, render_prompts, with_messages
from respondex.operators.embed import EmbeddingStore, embed_queries
from respondex.operators.keys import assign_ids
from respondex.operators.reshape import keep_first, new_texts, split_null_keys, to_long
from respondex.operators.search import display_lines, search
from respondex.schemas import QUESTIONS, STORED_TEXTS, STUDENT_KEY, TEXT_KEY, TEXTS
from respondex.session import drop_scratch, path_exists, scratch_path
from respondex.sources.embeddings import export_embeddings
from respondex.sources.survey import SOURCE_ORDER

DEFAULT_MODEL = "openai"


def add_texts(
    survey: DataFrame,
    texts_path: str,
    *,
    questions: Sequence[str] = QUESTIONS,
    key: str = STUDENT_KEY,
    order: Sequence[str] = (SOURCE_ORDER,),
) -> None:
    """Append the survey's answers to the text table, numbered on from the last id there.

    Of several answers under one key the first in ``order`` counts, and what is stored
    already always wins. Answers without a key can't be joined to anything; a run puts those
    that no earlier run has put there into a table beside, ``<texts_path>-unkeyed/run=``.
    """
    spark = survey.sparkSession
    keyed, unkeyed = split_null_keys(to_long(survey, questions=questions, key=key, keep=order))
    run = f"{time.time_ns():020d}"
    unkeyed = unkeyed.select(*TEXTS.fieldNames())
    beside = unkeyed_path(texts_path)
    if path_exists(spark, beside):
        earlier = spark.read.schema(TEXTS).parquet(beside).select(*TEXTS.fieldNames()).distinct()
        alike = [unkeyed[c].eqNullSafe(earlier[c]) for c in TEXTS.fieldNames()]
        unkeyed = unkeyed.join(earlier, alike, "left_anti")
    unkeyed.write.parquet(f"{beside}/run={run}")
    rows = keep_first(keyed, order)
    last = 0
    if path_exists(spark, texts_path):
        stored = read_texts(spark, texts_path)
        rows = new_texts(rows, stored)
        last = stored.agg(F.max("id")).first()[0] or 0
    path = scratch_path(spark, "new-texts")
    rows.write.parquet(path)
    rows = spark.read.schema(TEXTS).parquet(path)
    ids = assign_ids(rows.select(*TEXT_KEY), TEXT_KEY, start=last + 1)
    numbered = rows.join(ids, list(TEXT_KEY)).select("id", *TEXTS.fieldNames())
    numbered.write.mode("append").parquet(texts_path)
    drop_scratch(spark, path)


def unkeyed_path(texts_path: str) -> str:
    return f"{texts_path.rstrip('/')}-unkeyed"


def read_texts(spark: SparkSession, texts_path: str) -> DataFrame:
    return spark.read.schema(STORED_TEXTS).parquet(texts_path)


def build(
    survey: DataFrame,
    texts_path: str,
    store_path: str,
    export_path: str,
    embedding_model: Model,
    *,
    batches: int | None = None,
    **reshape,
) -> None:
    """Survey to texts, texts to vectors (only those that lack one), vectors to Parquet."""
    spark = survey.sparkSession
    add_texts(survey, texts_path, **reshape)
    texts = read_texts(spark, texts_path).drop("id")
    store = EmbeddingStore(spark, store_path)
    store.add_pending(texts, embedding_model, batches=batches)
    export_embeddings(texts, store.embeddings(), export_path)


def _resolve(choice: str | Model) -> Model:
    return model(choice) if isinstance(choice, str) else choice


def question_vector(spark: SparkSession, question: str, choice: str | Model) -> list[float]:
    asked = spark.createDataFrame([(0, question)], "qid int, text string")
    row = embed_queries(asked, _resolve(choice)).first()
    if row["vector"] is None:
        raise RuntimeError(f"the question could not be embedded: {row['error']}")
    return row["vector"]


def search_question(
    question: str,
    survey: DataFrame,
    embeddings: DataFrame,
    *,
    limit: int = 25,
    model: str | Model = DEFAULT_MODEL,
    **options,
) -> DataFrame:
    """Embed one question and rank the answers. ``embeddings`` must be of ``model``."""
    vector = question_vector(survey.sparkSession, question, model)
    return search(survey, embeddings, vector, limit=limit, **options)


def search_lines(question: str, survey: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """``search_question`` as printable lines."""
    found = search_question(question, survey, embeddings, include_embedding=False, **options)
    return display_lines(found, options.get("key", STUDENT_KEY))


def prepare_prompts(
    queries: DataFrame,
    survey: DataFrame,
    embeddings: DataFrame,
    *,
    template: str,
    limit: int = 5,
    model: str | Model = DEFAULT_MODEL,
    **options,
) -> DataFrame:
    """For every row of ``queries(qid, text)``: context, prompt and chat messages.

    The question vectors are stored first, so that no question is embedded twice.
    """
    spark = queries.sparkSession
    path = scratch_path(spark, "questions")
    embed_queries(queries.select("qid", "text"), _resolve(model)).write.parquet(path)
    found = search_batch(survey, embeddings, spark.read.parquet(path), limit=limit, **options)
    contexts = build_context(found, options.get("key", STUDENT_KEY))
    return with_messages(render_prompts(contexts, queries, template))


def prepare_prompt(
    question: str, results: DataFrame, template: str, key: str = STUDENT_KEY
) -> DataFrame:
    """Context, prompt and chat messages for one question and its search results."""
    asked = results.sparkSession.createDataFrame([(0, question)], "qid int, text string")
    contexts = build_context(results.withColumn("qid", F.lit(0)), key)
    return with_messages(render_prompts(contexts, asked, template)).drop("qid")
