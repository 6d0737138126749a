"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: How stored tables are packed: copies of a text within a page, as listings of one entity often are, take little room.
PACKED = {"compression": "zstd"}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or the one set on the context."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        # One machine, as in tests: a folder of its own is shared by all there is.
        context.setCheckpointDir(tempfile.mkdtemp(prefix="listingloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores. A small file is often one split, and heavy work on it one task.

    Input with at least as many splits as cores, so any large input, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query in here go when it ends. Otherwise they stay on the executors' disks until the driver happens to collect
    its garbage, so a job of many steps holds those of all steps at once.

    For steps that store their rows: a frame that is run a second time would have to shuffle again.
    """
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a stored table: read many times, computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.parquet(path)


def _held(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, (_held(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(16), lambda total, item: total + _held(item, kind.elementType)), F.lit(16))
    return F.lit(8)


def unless_large(rows: DataFrame) -> DataFrame:
    """Rows of a stored table, which Spark joins by a shuffle if they take more memory than it may broadcast.

    Spark goes by the size of files. Packed rows take ten times as much and more in memory, first in the driver's, which puts a
    broadcast together. So they are measured, by one pass.
    """
    most = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    held = _held(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema)
    return rows.hint("merge") if (rows.agg(F.sum(held)).first()[0] or 0) > most else rows
