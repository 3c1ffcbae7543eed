"""Parquet embeddings: read, keep a local copy, export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.models import Model
from respondex.operators.keys import orphan_keys
from respondex.schemas import EMBEDDINGS, TEXT_KEY
from respondex.session import MAX_BROADCAST_KEYS, path_exists, remove, rename


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(student_id, question_id, embedding), picked by name whatever the file order."""
    table = spark.read.parquet(path)
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EMBEDDINGS])


def materialize_if_absent(spark: SparkSession, source: str, copy: str) -> DataFrame:
    """Copy a Parquet table once and read the copy from then on.

    What is at ``copy``, a folder or a single file, is never touched. A new copy gets its
    name only when it is whole, so a lost run leaves nothing there.
    """
    copy = copy.rstrip("/")
    if not path_exists(spark, copy):
        unfinished = f"{copy}.{uuid.uuid4().hex}"
        spark.read.parquet(source).write.parquet(unfinished)
        if not rename(spark, unfinished, copy) and not path_exists(spark, copy):
            raise RuntimeError(f"could not rename {unfinished} to {copy}")
    return spark.read.parquet(copy)


def model_embeddings(spark: SparkSession, model: Model, copies: str) -> DataFrame:
    """The answer vectors of a model, from a copy under ``copies`` made on first use."""
    copy = f"{copies.rstrip('/')}/{model.name}.parquet"
    if model.source:
        materialize_if_absent(spark, model.source, copy)
    return read_embeddings(spark, copy)


def export_join(texts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per text with its vector, NULL where there is none."""
    return (
        texts.select(*TEXT_KEY)
        .join(embeddings.select(*EMBEDDINGS.fieldNames()), list(TEXT_KEY), "left")
        .select(*EMBEDDINGS.fieldNames())
    )


def export_rows(texts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The rows of ``export_join`` without moving vectors through a shuffle.

    Vectors normally all belong to a text. Then the export is the embedding table as it
    is, plus the keys of the texts without one. Whether that holds is checked on keys
    alone (one job): a few vectors without a text are filtered by broadcast, and only many
    of them make a join necessary that moves vectors. Text keys must be unique.
    """
    on = list(TEXT_KEY)
    keys = texts.select(*on)
    kept = embeddings.select(*EMBEDDINGS.fieldNames()).dropna(subset=on)
    orphans = orphan_keys(kept, texts).select(*on)
    n_orphans = orphans.count()
    if n_orphans > MAX_BROADCAST_KEYS:
        kept = kept.join(keys, on, "left_semi")
    elif n_orphans:
        kept = kept.join(F.broadcast(orphans), on, "left_anti")
    missing = keys.join(embeddings.select(*on).distinct(), on, "left_anti")
    null_vector = F.lit(None).cast(EMBEDDINGS["embedding"].dataType).alias("embedding")
    return kept.unionByName(missing.select(*on, null_vector))


def export_embeddings(texts: DataFrame, embeddings: DataFrame, path: str) -> None:
    """Write the export to Parquet, replacing what is there.

    The new export is written beside and takes the name once it is whole, so a run that dies
    on the way leaves the old one. If it dies between the two renames, the old one lies next
    to the path, with ``.old`` in its name.
    """
    spark, path = texts.sparkSession, path.rstrip("/")
    token = uuid.uuid4().hex
    unfinished, old = f"{path}.{token}", f"{path}.old-{token}"
    export_rows(texts, embeddings).write.parquet(unfinished)
    replaced = path_exists(spark, path)
    if replaced and not rename(spark, path, old):
        raise RuntimeError(f"could not rename {path} to {old}")
    if not rename(spark, unfinished, path):
        raise RuntimeError(f"could not rename {unfinished} to {path}")
    if replaced:
        remove(spark, old)
