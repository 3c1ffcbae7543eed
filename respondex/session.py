"""Session helpers: shared scratch space, file checks and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Keys are short strings, so this many of them stay in the tens of megabytes.
MAX_BROADCAST_KEYS = 200_000

_local_base: str | None = None


def scratch_base(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; it then gets one temporary folder. On a
    cluster a machine-local folder would be invisible to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _local_base
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="respondex-")
    return _local_base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared scratch folder; nothing exists there yet."""
    return f"{scratch_base(spark)}/respondex/{label}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder or file; False if ``new`` could not be made."""
    fs, path = _fs(spark, old)
    return fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(new))


def write_record(spark: SparkSession, path: str) -> None:
    """Make an empty file, and the folders above it."""
    fs, hadoop_path = _fs(spark, path)
    fs.create(hadoop_path, True).close()


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if it isn't there."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isFile())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of a table that this package manages."""
    fs, hadoop_path = _fs(spark, path)
    fs.delete(hadoop_path, True)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table made at ``scratch_path``, and nothing else."""
    if not path.startswith(f"{scratch_base(spark)}/respondex/"):
        raise ValueError(f"not a scratch table: {path}")
    remove(spark, path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, the one its own broadcast decision uses. Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_auto_broadcast(df: DataFrame) -> bool:
    """True where Spark would broadcast ``df`` on its own; no hint is involved."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= limit


def input_bytes(df: DataFrame) -> int:
    """Estimated size of all tables ``df`` reads, whatever is done with them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
