"""Table shapes and fixed column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

QUESTIONS = ("r1", "r2", "r3", "r4")
STUDENT_KEY = "perm"
TEXT_KEY = ("student_id", "question_id")

TEXTS = T.StructType(
    [
        T.StructField("student_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

# As a build stores them.
STORED_TEXTS = T.StructType([T.StructField("id", T.LongType()), *TEXTS.fields])

EMBEDDINGS = T.StructType(
    [
        T.StructField("student_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def create_tables(
    spark: SparkSession, location: str, tables: Sequence[str] | Mapping[str, T.StructType]
) -> list[str]:
    """Create the typed tables that are not there yet, and return their names.

    ``tables`` are the names of models, which makes ``texts`` and one table for each model,
    or names with their schemas.
    """
    wanted = (
        dict(tables)
        if isinstance(tables, Mapping)
        else {"texts": TEXTS} | {f"embeddings_{name}": EMBEDDINGS for name in tables}
    )
    for name, schema in wanted.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"LOCATION '{location.rstrip('/')}/{name}'"
        )
    return list(wanted)
