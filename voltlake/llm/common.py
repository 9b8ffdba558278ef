"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that an operator may broadcast after it has checked the size; beyond it, a shuffle join is used.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    Without either, a folder under the warehouse in local mode, and an error on a cluster.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return where.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if rows * row_bytes is within BROADCAST_BYTES; the plain frame otherwise."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(doc_id as text) mod 5 is 0; they are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def with_prefix(df: DataFrame, key: str, value: str, out: str, fan: int = 1024, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of value over all smaller keys (key: long, unique, from 0) in two levels, so no task sees all rows.

    within: columns without nulls; sums are over the rows of equal ones, where keys are unique.
    """
    from pyspark.sql import Window as W

    upper = df.groupBy(*within, (F.col(key) / fan).cast("long").alias("_up")).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*within).orderBy("_up").rowsBetween(W.unboundedPreceding, -1)
    upper = upper.select(*within, "_up", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*within, "_up").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_up", (F.col(key) / fan).cast("long"))
        .join(upper, [*within, "_up"])
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_up", "_base")
    )


def trimmed(parts: Iterable) -> Iterator:
    """parts, and then freed memory back to the system: Python workers live on after their tasks."""
    import pyarrow as pa

    yield from parts
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
