"""Turn ranked answers into prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondex.functions.text import CONTEXT_SEPARATOR, chat_messages, fill_template
from respondex.schemas import STUDENT_KEY


def build_context(results: DataFrame, key: str = STUDENT_KEY) -> DataFrame:
    """Per ``qid``: the answer texts in result order with a blank line between them.

    The order is ``result_rank`` if the results have it. The rows of one question become
    one string, so ``results`` should be a top-k search. Rows without a text are skipped
    and counted in ``n_missing``.
    """
    if "result_rank" in results.columns:
        order = [F.col("result_rank")]
    else:
        # The flag comes first because NULL sorts before numbers inside a struct.
        order = [
            F.col("result_distance").isNull().alias("last"),
            F.col("result_distance"),
            F.col(key).cast("string").alias("key"),
            F.col("result_question_id"),
        ]
    place = F.struct(*order, "result_text")
    ordered = F.sort_array(F.collect_list(place))
    texts = F.transform(ordered, lambda row: row["result_text"])
    return results.groupBy("qid").agg(
        F.array_join(texts, CONTEXT_SEPARATOR).alias("context"),
        F.count("result_text").alias("n_texts"),
        F.count_if(F.col("result_text").isNull()).alias("n_missing"),
    )


def render_prompts(
    contexts: DataFrame, queries: DataFrame, template: str
) -> DataFrame:
    """``qid, question, context, prompt`` for every row of ``queries(qid, text)``.

    A question for which nothing was found gets an empty context.
    """
    asked = queries.select("qid", F.col("text").alias("question"))
    joined = asked.join(contexts.select("qid", "context"), "qid", "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
    places = {"context": F.col("context"), "question": F.col("question")}
    return joined.withColumn("prompt", fill_template(template, places))


def with_messages(prompts: DataFrame) -> DataFrame:
    """Add the ``messages`` list a chat model takes."""
    return prompts.withColumn("messages", chat_messages(F.col("prompt")))
