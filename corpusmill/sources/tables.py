"""The driver's Parquet tables, read by Spark only, so that any Hadoop path works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of this size in bytes are dealt out to the cores, at least so many bytes to each.
DEALT, LEAST_PART = (1 << 20, 512 << 20), 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dealt_out(rows: DataFrame) -> DataFrame:
    """The rows of files, in up to as many partitions as there are cores if the files are fewer and small.

    A file may be one row group, which one task reads; without this, all that
    follows up to the next shuffle would run in that task.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not DEALT[0] <= size <= DEALT[1]:
        return rows
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, size // LEAST_PART)
    return rows.repartition(parts) if len(rows.inputFiles()) < parts else rows
