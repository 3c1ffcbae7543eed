"""The embedding job: find what lacks a vector, embed it, store it batch by batch."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respondex.functions.text import with_prefix
from respondex.models import BatchFunction, Model
from respondex.schemas import EMBEDDINGS, TEXT_KEY, TEXTS
from respondex.session import (
    MAX_BROADCAST_KEYS,
    drop_scratch,
    files_below,
    input_bytes,
    remove,
    scratch_path,
    write_record,
)


def embedded_keys(embeddings: DataFrame) -> DataFrame:
    """Keys that have a vector; a NULL vector marks a text still to do."""
    return embeddings.filter(F.col("embedding").isNotNull()).select(*TEXT_KEY)


def pending_texts(texts: DataFrame, done_keys: DataFrame) -> DataFrame:
    """Texts whose key is not among ``done_keys``, which may repeat."""
    return texts.join(done_keys.select(*TEXT_KEY).distinct(), list(TEXT_KEY), "left_anti")


def pending_rows(texts: DataFrame, done_keys: DataFrame) -> DataFrame | None:
    """``pending_texts`` after a look at how many there are; None if there are none.

    The look compares keys only. If few texts are pending, as after a top-up of the
    survey, their keys are broadcast and the stored texts need no shuffle at all.
    """
    keys = pending_texts(texts.select(*TEXT_KEY), done_keys)
    n_keys = keys.count()
    if n_keys == 0:
        return None
    if n_keys <= MAX_BROADCAST_KEYS:
        return texts.join(F.broadcast(keys), list(TEXT_KEY), "left_semi")
    return pending_texts(texts, done_keys)


def embed_column(text: Column, model: Model) -> Column:
    """``struct<embedding, error>`` of a text column.

    A text the model cannot embed gets a NULL vector and the reason; the others of its
    batch are not lost. The column counts as non-deterministic so that Spark never moves
    or doubles the calls.
    """
    if model.load is None:
        raise ValueError(f"model {model.name!r} has no embedding function; see Model.using")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = model.load()
        for texts in batches:
            yield _embed_array(texts.to_pylist(), model, embed)

    result = "struct<embedding: array<float>, error: string>"
    return F.arrow_udf(run, result).asNondeterministic()(text)


def _embed_array(texts: list, model: Model, embed: BatchFunction) -> pa.Array:
    matrix = np.zeros((len(texts), model.dim), dtype=np.float32)
    errors: list[str | None] = ["text is NULL"] * len(texts)
    todo = [i for i, text in enumerate(texts) if text is not None]
    for start in range(0, len(todo), model.batch_size):
        places = todo[start : start + model.batch_size]
        vectors = _call(embed, [texts[i] for i in places])
        if isinstance(vectors, np.ndarray) and _fine(vectors, len(places), model):
            matrix[places] = _scaled(vectors) if model.normalize else vectors
            for i in places:
                errors[i] = None
            continue
        for i, found in zip(places, vectors, strict=True):
            errors[i] = found if isinstance(found, str) else _place(found, matrix[i], model)
    failed = np.array([e is not None for e in errors], dtype=bool)
    ends = np.concatenate([[0], np.cumsum(~failed) * model.dim]).astype(np.int32)
    vectors = pa.ListArray.from_arrays(
        pa.array(ends), pa.array(matrix[~failed].ravel()), mask=pa.array(failed)
    )
    return pa.StructArray.from_arrays(
        [vectors, pa.array(errors, pa.string())], names=["embedding", "error"]
    )


def _fine(vectors: np.ndarray, n: int, model: Model) -> bool:
    """True for a matrix that needs no look at its single rows."""
    return vectors.shape == (n, model.dim) and bool(np.isfinite(vectors).all())


def _scaled(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def _call(embed: BatchFunction, texts: list[str]) -> Sequence:
    """Vectors of a batch; if the batch fails, each text is tried alone."""
    try:
        found = embed(texts)
        if len(found) == len(texts):
            return found
    except Exception as problem:
        if len(texts) == 1:
            return [f"{type(problem).__name__}: {problem}"]
    if len(texts) == 1:
        return ["the model returned another number of vectors"]
    return [_call(embed, [text])[0] for text in texts]


def _place(found: Sequence[float] | None, row: np.ndarray, model: Model) -> str | None:
    """Put a vector into its row, or say why not."""
    if found is None:
        return "the model returned nothing"
    vector = np.asarray(found, dtype=np.float64)
    if vector.shape != (model.dim,):
        return f"the model returned shape {vector.shape}, expected ({model.dim},)"
    if not np.isfinite(vector).all():
        return "the model returned a number that is not finite"
    norm = np.linalg.norm(vector) if model.normalize else 0.0
    row[:] = vector / norm if norm else vector
    return None


def embed_texts(
    rows: DataFrame, model: Model, text: str = "text", partitions: int | None = None
) -> DataFrame:
    """All columns but ``text``, plus ``embedding`` and ``error``.

    Map-only over the tasks that read ``rows``; where those are too few for the model's
    cost, ``partitions`` spreads the texts first.
    """
    kept = [c for c in rows.columns if c != text]
    if partitions:
        rows = rows.repartition(partitions, *kept)
    return rows.select(*kept, embed_column(F.col(text), model).alias("_found")).select(
        *kept, "_found.embedding", "_found.error"
    )


#: Rows that one copy of a repeated text's vector is joined to.
_COPY_ROWS = 1 << 16


def text_hash(text: Column | str) -> Column:
    """What equal texts have in common, and others don't."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def embed_distinct(
    rows: DataFrame, model: Model, text: str = "text", partitions: int | None = None
) -> DataFrame:
    """``embed_texts`` with one call for each distinct text, plus ``text_hash``.

    Texts are gathered by content, repeated ones within their tasks first. A text of a single
    row carries its row along and is done once it is embedded. The vector of a repeated text
    is joined back by content, in as many copies as it takes for each to meet a bounded
    number of rows. The vectors are written first, so that no call is made twice.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != text]
    known = rows.withColumn("_content", text_hash(text))
    grouped = known.groupBy("_content").agg(
        F.first(text).alias("_text"),
        F.count(F.lit(1)).alias("_n"),
        F.first(F.struct(*kept)).alias("_row"),
    )
    if partitions:
        grouped = grouped.repartition(partitions, "_content")
    path = scratch_path(spark, "distinct")
    found = embed_texts(grouped, model, "_text")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    own = found.where(F.col("_n") == 1).select(
        "_row.*", "embedding", "error", F.col("_content").alias("text_hash")
    )
    copies = F.ceil(F.col("_n") / _COPY_ROWS)
    many = found.where(F.col("_n") > 1)
    if many.isEmpty():
        return own
    hot = many.where(copies > 1).select(F.col("_content").alias("_hot"), copies.alias("_copies"))
    copied = many.select(
        "_content",
        F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_copy"),
        "embedding",
        "error",
    )
    # Null texts are alike as well, and have no hash.
    mine = F.coalesce(F.pmod(F.xxhash64(*kept), F.col("_copies")), F.lit(0)).alias("_copy")
    dealt = known.join(hot, F.col("_content") == F.col("_hot"), "left").select(*kept, "_content", mine)
    met = (dealt["_copy"] == copied["_copy"]) & dealt["_content"].eqNullSafe(copied["_content"])
    repeated = dealt.join(copied, met).select(
        *[dealt[c] for c in kept], "embedding", "error", dealt["_content"].alias("text_hash")
    )
    return own.unionByName(repeated)


def embed_queries(queries: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Question vectors: the model's prefix goes before the text, on questions only.

    A question that fails stays, with a NULL vector and the reason.
    """
    prefixed = queries.withColumn("_asked", with_prefix(F.col(text), model.query_prefix))
    found = embed_texts(prefixed, model, "_asked")
    return found.withColumnRenamed("embedding", "vector")


_FILE_BYTES = 128 << 20
_BATCH_BYTES = 16 << 30


class EmbeddingStore:
    """Vectors of one model in a folder tree ``data/run=/batch=/status=``.

    Every batch is one Spark write and counts only once its record lies in the folder
    ``done``, whatever markers the committer writes. So a run that dies leaves whole
    batches and no half ones, and one listing tells which count. Vectors and failures are
    split by the ``status`` folder: looking up which keys are done reads neither the
    vectors nor the failures. One run at a time may write.

    Records are named ``run-batch``. Those of a refreshing run end in ``-refresh``: its
    vectors take the place of earlier ones. One that ends in ``-compact`` takes the place of
    all records before it.
    """

    _SCHEMA = T.StructType(
        [*EMBEDDINGS.fields]
        + [T.StructField(n, T.StringType()) for n in ("error", "text_hash", "first_run")]
        + [T.StructField(n, T.StringType()) for n in ("run", "batch", "status")]
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def records(self) -> list[str]:
        """The records that count, oldest first."""
        found = files_below(self.spark, f"{self.path}/done")
        whole = [i for i, name in enumerate(found) if name.endswith("-compact")]
        return found[whole[-1] :] if whole else found

    def _stored(self, status: str, records: Sequence[str] | None = None) -> DataFrame:
        done = [name.split("-") for name in (self.records() if records is None else records)]
        batches = [f"{self.path}/data/run={d[0]}/batch={d[1]}" for d in done]
        if not batches:
            return self.spark.createDataFrame([], self._SCHEMA)
        reader = self.spark.read.schema(self._SCHEMA).option("basePath", f"{self.path}/data")
        return reader.parquet(*batches).filter(F.col("status") == status)

    def _latest(self) -> DataFrame:
        """Rows with a vector, of each key those of the last run that refreshed it.

        Only keys of refreshing runs are compared; vectors aren't shuffled for it.
        """
        rows = self._stored("ok")
        again = [name for name in self.records() if name.endswith("-refresh")]
        if not again:
            return rows
        key = list(TEXT_KEY)
        last = self._stored("ok", again).groupBy(*key).agg(F.max("run").alias("_last"))
        seen = rows.join(last, key, "left")
        return seen.where(F.col("_last").isNull() | (F.col("run") == F.col("_last"))).drop("_last")

    def keys(self) -> DataFrame:
        return self._stored("ok").select(*TEXT_KEY)

    def embeddings(self) -> DataFrame:
        return self._latest().select(*EMBEDDINGS.fieldNames())

    def failures(self) -> DataFrame:
        """Failed attempts, all runs; a text may have been embedded by a later run."""
        run = F.coalesce("first_run", "run").alias("run")
        return self._stored("failed").select(*TEXT_KEY, "error", run)

    def outdated(self, texts: DataFrame) -> DataFrame:
        """The texts whose vector is of another text.

        What was stored without a hash of its text can't be compared and counts as right.
        """
        known = self._latest().select(*TEXT_KEY, F.col("text_hash").alias("_known"))
        compared = texts.join(known, list(TEXT_KEY)).where(text_hash("text") != F.col("_known"))
        return compared.select(*texts.columns)

    def add_pending(
        self,
        texts: DataFrame,
        model: Model,
        *,
        batches: int | None = None,
        files_per_batch: int | None = None,
        partitions: int | None = None,
        distinct: bool = True,
        refresh: bool = False,
    ) -> str | None:
        """Embed the texts that have no vector yet and return the run's name.

        With more than one batch the pending texts are first written out by batch, so each
        batch reads its own part only and a failure costs at most one batch of calls.
        Without ``batches`` there is one for every 16 GB of texts. The files of a batch are
        planned for 128 MB of input unless ``files_per_batch`` is given.
        ``partitions`` spreads the calls of a batch over that many tasks. Returns None if
        nothing was pending.

        Equal texts are embedded once (they lie in the same batch) unless ``distinct`` is
        off, which spares a shuffle of the texts. With ``refresh`` the texts that were edited
        since they were embedded are embedded again, in a run of their own that comes after
        the run of those without a vector; its name is returned if there is only that one.
        """
        plan = {"batches": batches, "files_per_batch": files_per_batch}
        plan |= {"partitions": partitions, "distinct": distinct}
        run = None
        pending = pending_rows(texts, self.keys())
        if pending is not None:
            run = self._add(pending, input_bytes(texts), model, "", **plan)
        if refresh:
            path = scratch_path(self.spark, "outdated")
            self.outdated(texts.select(*TEXT_KEY, "text")).write.parquet(path)
            edited = self.spark.read.schema(TEXTS).parquet(path)
            if not edited.isEmpty():
                again = self._add(edited, input_bytes(edited), model, "-refresh", **plan)
                run = run or again
            drop_scratch(self.spark, path)
        return run

    def _add(
        self,
        pending: DataFrame,
        size: int,
        model: Model,
        kind: str,
        *,
        batches: int | None,
        files_per_batch: int | None,
        partitions: int | None,
        distinct: bool,
    ) -> str:
        run = f"{time.time_ns():020d}"
        pending = pending.select(*TEXT_KEY, "text")
        if batches is None:
            batches = math.ceil(size / _BATCH_BYTES)
        if batches <= 1:
            self._write(pending, model, run, 0, kind, partitions, distinct)
            return run
        if files_per_batch is None:
            files_per_batch = max(1, math.ceil(size / batches / _FILE_BYTES))
        staged = scratch_path(self.spark, "pending")
        content = F.xxhash64("text") if distinct else F.xxhash64(*TEXT_KEY)
        (
            pending.withColumn("batch", F.pmod(content, F.lit(batches)))
            .withColumn("_slice", F.pmod(F.xxhash64(*TEXT_KEY), F.lit(files_per_batch)))
            .repartition(batches * files_per_batch, "batch", "_slice")
            .drop("_slice")
            .write.partitionBy("batch")
            .parquet(staged)
        )
        schema = T.StructType([*TEXTS.fields, T.StructField("batch", T.LongType())])
        parts = self.spark.read.schema(schema).parquet(staged)
        try:
            for number in range(batches):
                part = parts.filter(F.col("batch") == number)
                self._write(part.drop("batch"), model, run, number, kind, partitions, distinct)
        finally:
            drop_scratch(self.spark, staged)
        return run

    def _write(
        self,
        rows: DataFrame,
        model: Model,
        run: str,
        number: int,
        kind: str,
        partitions: int | None,
        distinct: bool,
    ) -> None:
        if distinct:
            found = embed_distinct(rows, model, partitions=partitions)
        else:
            hashed = rows.withColumn("text_hash", text_hash("text"))
            found = embed_texts(hashed, model, partitions=partitions)
        self._save(found, run, number)
        write_record(self.spark, f"{self.path}/done/{run}-{number}{kind}")

    def _save(self, found: DataFrame, run: str, number: int) -> None:
        status = F.when(F.col("error").isNull(), "ok").otherwise("failed")
        target = f"{self.path}/data/run={run}/batch={number}"
        found.withColumn("status", status).write.mode("overwrite").partitionBy(
            "status"
        ).parquet(target)

    def compact(self, file_bytes: int = _FILE_BYTES) -> str | None:
        """Rewrite all batches into few files under one record; returns its run.

        Readers list the records: before the new record is there they see the old batches,
        after that the new one alone. A run that dies leaves the old state and a folder that
        nobody reads. The old folders stay for those who are reading them; ``clean`` deletes
        them. None if there is at most one batch.
        """
        old = self.records()
        if len(old) <= 1:
            return None
        run = f"{time.time_ns():020d}"
        columns = [*EMBEDDINGS.fieldNames(), "error", "text_hash"]
        first = F.coalesce("first_run", "run").alias("first_run")
        rows = self._latest().unionByName(self._stored("failed")).select(*columns, first)
        files = max(1, math.ceil(input_bytes(rows) / file_bytes))
        self._save(rows.repartition(files), run, 0)
        write_record(self.spark, f"{self.path}/done/{run}-0-compact")
        return run

    def clean(self) -> None:
        """Delete what a compaction has replaced. Nobody may still be reading it."""
        every, now = files_below(self.spark, f"{self.path}/done"), set(self.records())
        for name in every:
            if name not in now:
                run, number = name.split("-")[:2]
                remove(self.spark, f"{self.path}/done/{name}")
                remove(self.spark, f"{self.path}/data/run={run}/batch={number}")
