"""Files beside the driver's tables: JSON lines, manifests, splits, reports, logs, caches."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    # at the default of 20 million characters a row with a longer text would come back as nulls
    return spark.read.schema(schema).option("maxStringLen", 2**31 - 1).json(path)


def read_instructions(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Instruction rows from JSON lines; a missing file is a warning and None."""
    if not exists(spark, path):
        warnings.warn(f"no instruction file {path}", stacklevel=2)
        return None
    return spark.read.schema(schema).json(path)


def load_rows(spark: SparkSession, hub: str | None, local: str | None, schema: str, adapt: Callable[[DataFrame], DataFrame] = lambda rows: rows, max_samples: int | None = None, key: str | None = None, split: str = "test") -> DataFrame:
    """A task's rows: the hub's split or a fallback, else local JSON lines; adapted, then the first max_samples by key.

    Without either the result is an empty table of the schema, adapted.
    """
    rows = read_split(spark, hub, split) if hub else None
    if rows is None or rows.isEmpty():
        rows = read_jsonl(spark, local, schema) if local else spark.createDataFrame([], schema)
    if max_samples is not None:
        rows = cap(rows, max_samples, key or rows.columns[0])
    return adapt(rows)


def read_split(spark: SparkSession, root: str, split: str = "test", fallbacks: tuple[str, ...] = ("validation", "train")) -> DataFrame | None:
    """root/split, or the first fallback that is there, or None."""
    for name in (split, *fallbacks):
        if exists(spark, f"{root}/{name}"):
            return spark.read.parquet(f"{root}/{name}")
    return None


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """prompt, chosen, rejected from JSON lines; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema("prompt string, chosen string, rejected string").json(path)


def cap(rows: DataFrame, n: int | None, key: str) -> DataFrame:
    """The first n rows by key, rows without one last; all for None."""
    return rows if n is None else rows.orderBy(F.col(key).asc_nulls_last()).limit(n)


def prefix_sample(rows: DataFrame, n: int, key: str, text: str = "text") -> DataFrame:
    """The first n rows; empty texts count for n and are dropped after."""
    return rows.orderBy(key).limit(n).filter(F.col(text) != "")


def save_manifest(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("overwrite").format(kind).save(path)


def load_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or else JSON lines."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    if len(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)):
        return spark.read.parquet(path)
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def save_splits(splits: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """splits/ by split, and stats/ with the counts as one JSON row."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def save_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small rendered text as one file, in any store that Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def save_contamination(rows: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """by_benchmark/ with one JSON folder a benchmark, and full_report.json: the summary of all methods with counts a benchmark."""
    rows.write.mode("overwrite").partitionBy("benchmark").json(f"{path}/by_benchmark")
    counts = {r["benchmark"]: r["n"] for r in rows.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a benchmark
    report = {"benchmarks": counts, "methods": [r.asDict() for r in summary.collect()] if summary is not None else []}  # a row a method
    write_text(rows.sparkSession, f"{path}/full_report.json", json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True))


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.current_timestamp().cast("string")) if "timestamp" in rows.columns else F.current_timestamp().cast("string")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_jsonl(spark, path, schema)


def cache_key(**settings) -> str:
    """md5 over settings in order of name; the name of a cached result."""
    return hashlib.md5("|".join(f"{k}={settings[k]}" for k in sorted(settings)).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, make, **settings) -> DataFrame:
    """The result under its key, made and written if it is not there."""
    path = f"{folder}/{cache_key(**settings)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
