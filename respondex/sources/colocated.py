"""Tables stored in buckets of students, so that joins between them move nothing.

Texts, vectors and the survey all meet by student. Stored with the same number of buckets of
the student's key, rows that meet lie in buckets of the same number, and Spark joins and
groups them bucket by bucket without a shuffle. The vectors, by far the largest table, are
then moved once, when they are stored, and not for every join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.session import input_bytes

#: Bytes that a bucket of the largest table should have.
BUCKET_BYTES = 256 << 20
#: A bucket of more rows than so many times the average keeps a table from being bucketed:
#: one task would read it, where a shuffle's skewed partitions can be split.
MOST_UNEVEN = 8


def buckets_for(largest: DataFrame) -> int:
    """How many buckets tables should have that are joined with ``largest``."""
    return max(1, math.ceil(input_bytes(largest) / BUCKET_BYTES))


def largest_bucket(rows: DataFrame, key: str, buckets: int) -> float:
    """Rows of the largest bucket over those of an average one. Reads the key only."""
    bucket = F.pmod(F.hash(F.col(key)), F.lit(buckets))
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    most, every = counted.agg(F.max("n"), F.sum("n")).first()
    return most * buckets / every if every else 0.0


def store_colocated(
    rows: DataFrame, name: str, key: str, buckets: int, path: str | None = None
) -> bool:
    """Save ``rows`` as table ``name`` in ``buckets`` of ``key``; True if it is in buckets.

    A key that many rows share makes one bucket too large. Such a table is saved without
    buckets: joins then shuffle it, and give the same rows. ``path`` is where the files go,
    the warehouse by default. Fails if the table is there.
    """
    even = buckets == 1 or largest_bucket(rows, key, buckets) <= MOST_UNEVEN
    dealt = rows.repartition(buckets, key) if even else rows
    writer = dealt.write.format("parquet")
    if path:
        writer = writer.option("path", path)
    if even:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return even


def read_colocated(spark: SparkSession, name: str) -> DataFrame:
    """A table stored by ``store_colocated``.

    Joins by (student, question) may use the buckets of students only if Spark needn't
    deal rows by all columns of the join, so that setting is made for the session. It
    changes no result.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(name)
