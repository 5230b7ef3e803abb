"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="rfcover-checkpoint-"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a round's result below the checkpoint folder and go on from the files.

    The files are columns, compressed, and computed once (a checkpoint runs its last stage
    twice and keeps plain rows); shuffles that made them are dropped with the write.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}")
    where.getFileSystem(conf).deleteOnExit(where)
    path = where.toString()
    with without_shuffle_files(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def without_shuffle_files(spark: SparkSession):
    """Queries that run within drop their shuffle files as soon as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition rows by ``keys`` into the session's full number of partitions.

    Used before steps that turn a row into many (grids, samples, candidate pairs): the
    input is small in bytes, so adaptive execution would fold it into few tasks. Later
    grouping on the same keys needs no further shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
