"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the session is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tokenlode-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Executions within let go of their shuffle files when they end. For those whose DataFrame isn't executed again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`written`, and the path, for `discard`."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: later stages start from it, and it outlives the executors that made it."""
    return kept(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def running(df: DataFrame, by: list[str], order: list, *values: str) -> DataFrame:
    """df with upto_<value> for each of values: its sum over the rows of the same `by` up to and with this one, in an order that has no ties.

    Rows are range-partitioned by `by` and order, summed within their partition, and what the partitions before
    hold, a row for each, is added: no task has all rows of a `by`.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    d = written(df.repartitionByRange(*keys).withColumn("part__", F.spark_partition_id()), "ranges")
    parts = Window.partitionBy(*by).orderBy("part__")
    before = d.groupBy(*by, "part__").agg(*[F.sum(v).alias(v) for v in values])
    before = before.select(*by, "part__", *[(F.sum(v).over(parts) - F.col(v)).alias(f"before_{v}") for v in values])
    local = Window.partitionBy(*by, "part__").orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [*by, "part__"])
    return d.withColumns({f"upto_{v}": F.sum(v).over(local) + F.col(f"before_{v}") for v in values}).drop("part__", *[f"before_{v}" for v in values])
