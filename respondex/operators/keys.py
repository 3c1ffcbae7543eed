"""Key checks and surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.functions.vectors import has_null_element
from respondex.schemas import TEXT_KEY
from respondex.session import scratch_path

# monotonically_increasing_id() holds the partition number above this bit, the row
# position inside the partition below it.
_ROW_BITS = 33


def duplicate_keys(table: DataFrame, key: Sequence[str] = TEXT_KEY) -> DataFrame:
    """Keys that occur more than once, with their count."""
    counted = table.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(F.col("n_rows") > 1)


def orphan_keys(
    child: DataFrame, parent: DataFrame, key: Sequence[str] = TEXT_KEY
) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks, with the number of child rows.

    Both sides are reduced to one row per key inside each task before the join, so a hot
    key cannot pile up.
    """
    counted = child.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(parent.select(*key).distinct(), list(key), "left_anti")


def vector_faults(embeddings: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has another length or a null element. Nothing is raised here."""
    checked = embeddings.select(
        *TEXT_KEY,
        F.size("embedding").alias("length"),
        has_null_element(F.col("embedding")).alias("null_element"),
    )
    present = F.col("length") >= 0
    return checked.filter(present & ((F.col("length") != dim) | F.col("null_element")))


def assign_ids(
    rows: DataFrame, order: Sequence[str | Column], name: str = "id", start: int = 1
) -> DataFrame:
    """Number rows from ``start`` on in the order of ``order``; ties go as they come.

    Rows are range-partitioned and sorted, so partition p holds what comes after
    partition p - 1. An id is then the rows before the partition plus the position in it.
    Range bounds are sampled and may differ between two runs of the same plan, so the
    sorted rows are written once and both counts and rows come from that table.
    """
    placed = _sorted_by_range(rows, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the sort, so this window stays as small as the task list.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_size").over(before), F.lit(0))
    starts = sizes.select("_part", earlier.alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_in_part") + start).alias(name), *rows.columns
    )


def _sorted_by_range(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``rows``, written in order, with the partition of each and its place in there."""
    spark = rows.sparkSession
    path = scratch_path(spark, "ids")
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_position", F.monotonically_increasing_id())
    )
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select(
        *rows.columns,
        F.shiftright("_position", _ROW_BITS).alias("_part"),
        F.col("_position").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_in_part"),
    )


def number_within(
    rows: DataFrame, group: str, order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """Number the rows of each ``group`` from 1 on in the order of ``order``.

    A window would put a group into one task. Here all rows are sorted by range of (group,
    order), so a large group lies in many partitions. A number is then the group's rows in
    earlier partitions, plus the place among its rows in this one.
    """
    placed = _sorted_by_range(rows, [F.asc_nulls_first(group), *order])
    # A row for each partition and group in it: at most one for each of both.
    parts = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_in")).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_in_part").alias("_least")
    )
    before = Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_size").over(before), F.lit(0))
    starts = parts.select("_group", "_in", (earlier - F.col("_least") + 1).alias("_start"))
    # Written, Spark knows that they are few, and doesn't shuffle all rows to meet them.
    path = scratch_path(rows.sparkSession, "starts")
    starts.write.parquet(path)
    starts = rows.sparkSession.read.schema(starts.schema).parquet(path)
    same = (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group"))
    return placed.join(starts, same).select(
        *rows.columns, (F.col("_start") + F.col("_in_part")).cast("int").alias(name)
    )
