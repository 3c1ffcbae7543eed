"""The survey shape read from the given tables.

Every conversation turn is used. Four turns make one respondent with the answers r1..r4,
and a vector belongs to a text if its number is the turn's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.operators.reshape import to_long
from respondex.schemas import QUESTIONS


# Given schemas spare one job per read that would only look at a file footer.
_SCHEMAS = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _respondent():
    return (F.col("conv_id") * 2 + F.expr("turn div 4")).cast("string")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perm, r1..r4 and the attributes dept and first_gen."""
    turns = table(spark, sf_dir, "conversations")
    answers = [
        F.max(F.when(F.col("turn") % 4 == i, F.col("text"))).alias(q)
        for i, q in enumerate(QUESTIONS)
    ]
    return (
        turns.groupBy("conv_id", _respondent().alias("perm"))
        .agg(*answers)
        .select(
            "perm",
            *QUESTIONS,
            F.concat(F.lit("D"), (F.col("conv_id") % 5).cast("string")).alias("dept"),
            (F.col("conv_id") % 2).cast("int").alias("first_gen"),
        )
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(survey(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_id, question_id, embedding (width 64).

    Vectors are those of texts, as far as there are turns; the others are of students who
    are not in the survey.
    """
    turns = table(spark, sf_dir, "conversations").select(
        _respondent().alias("student_id"),
        F.concat(F.lit("r"), (F.col("turn") % 4 + 1).cast("string")).alias("question_id"),
        (F.col("conv_id") * 8 + F.col("turn")).alias("vec_id"),
    )
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    stranger = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return vectors.join(turns, "vec_id", "left").select(
        F.coalesce("student_id", stranger).alias("student_id"),
        F.coalesce("question_id", F.lit("r1")).alias("question_id"),
        "embedding",
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 9) -> list[float]:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id)
    return rows.select("embedding").first()["embedding"]
