"""What several operators of this folder use: tables, words, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.session import drop_scratch, scratch_path

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"

_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables written within each open ``passing`` block.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are deleted at its end.

    Those to be kept go at the end of the block around it, if there is one.
    """
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            drop_scratch(spark, path)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder; its lineage ends there.

    Lost executors then cost a read and not a recomputation, and several readers share
    one evaluation. The folder may be deleted once the session is over.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    open_blocks = _passing[:-1] if keep else _passing
    if open_blocks:
        open_blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; nulls count 0. No word list is built."""
    inner = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return inner.cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
