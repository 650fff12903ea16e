"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A document's words are maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder is set only where a session on one machine has none, as in tests; on a cluster that is a
    ValueError, as executors would not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no more than the rereading of files,
    and what is read more than once is computed once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def wide_hash(*columns: Column) -> list[Column]:
    """128 bits as two longs: xxhash64 under two different leading constants."""
    return [F.xxhash64(F.lit(0), *columns), F.xxhash64(F.lit(1), *columns)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bisect_column(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are <= ``key`` (a long), by binary search within an expression."""
    if not bounds:
        return F.lit(0)
    bits = len(bounds).bit_length()
    padded = bounds + [(1 << 63) - 1] * ((1 << bits) - len(bounds))
    array = F.from_json(F.lit(str(padded)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at))
