"""Queries that write files to the work folder and read them back: loaders, manifests, splits, logs, caches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import upper_by_letter
from corpusmill.operators import contamination, dedup, quality
from corpusmill.plans.corpus import CLUSTERS, ORDERED
from corpusmill.plans.registry import query
from corpusmill.sources import io
from corpusmill.sources.tables import table
from corpusmill.sources.workdir import new_path

ITEM = "item_id long, text string"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", "text")


def json_lines(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "items")
    items(spark, d).write.json(path)
    return path


query("jsonl_scan", "SELECT item_id, text FROM benchmark")(lambda s, d: io.read_jsonl(s, json_lines(s, d), ITEM))
query("instruction_scan", "SELECT item_id, text FROM benchmark")(lambda s, d: io.read_instructions(s, json_lines(s, d), ITEM))


@query("split_fallback", "SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0")
def split_fallback(spark: SparkSession, d: str) -> DataFrame:
    """There is no test split, so the validation split is read."""
    root = new_path(spark, "hub")
    for name, part in (("validation", 0), ("train", 1)):
        items(spark, d).filter(F.col("item_id") % 2 == part).write.parquet(f"{root}/{name}")
    return io.read_split(spark, root)


query("task_load", "SELECT item_id, upper(substr(text, 1, 3)) AS question FROM benchmark ORDER BY item_id LIMIT 25")(
    lambda s, d: io.load_rows(s, new_path(s, "none"), json_lines(s, d), ITEM, lambda rows: rows.select("item_id", upper_by_letter(F.substring("text", 1, 3)).alias("question")), 25, "item_id")
)
query("prefix_sample", "SELECT item_id FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 30) WHERE item_id % 3 <> 0")(
    lambda s, d: io.prefix_sample(items(s, d).withColumn("text", F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("text"))), 30, "item_id").select("item_id")
)


@query("preference_scan", "SELECT 'p' || item_id AS prompt, text AS chosen, reverse(text) AS rejected FROM benchmark")
def preference_scan(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "preferences")
    items(spark, d).select(F.concat(F.lit("p"), "item_id").alias("prompt"), F.col("text").alias("chosen"), F.reverse("text").alias("rejected")).write.json(path)
    return io.read_preferences(spark, path)


@query("manifest_roundtrip", "SELECT doc_id AS raw_index, length(text)::INT AS n_chars, kind FROM documents, (VALUES ('json'), ('parquet')) AS v(kind) WHERE text <> ''")
def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows, out = quality.manifest(table(spark, d, "documents")).select("raw_index", "n_chars"), None
    for kind in ("json", "parquet"):
        path = new_path(spark, f"manifest-{kind}")
        io.save_manifest(rows, path, kind)
        one = io.load_manifest(spark, path, "raw_index long, n_chars int").withColumn("kind", F.lit(kind))
        out = one if out is None else out.union(one)
    return out


@query("split_sink", f"WITH {CLUSTERS}, {ORDERED} SELECT split, count(*) AS n, (SELECT count(*) FROM documents) AS raw_count FROM f GROUP BY split")
def split_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "splits")
    splits = dedup.split_by_clusters(dedup.exact_clusters(table(spark, d, "documents")), 0.1, 0.1)
    io.save_splits(splits, path, dedup.split_stats(splits))
    raw = spark.read.json(f"{path}/stats").first()["raw_count"]
    return spark.read.parquet(f"{path}/splits").groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("raw_count", F.lit(raw).cast("long"))


@query("contamination_sink", "SELECT doc_id, 'b' || doc_id % 3 AS benchmark FROM documents WHERE doc_id % 5 = 0")
def contamination_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "contamination")
    found = table(spark, d, "documents").filter(F.col("doc_id") % 5 == 0).select("doc_id", F.concat(F.lit("b"), F.col("doc_id") % 3).alias("benchmark"))
    io.save_contamination(found, path)
    return spark.read.schema("doc_id long, benchmark string").json(f"{path}/by_benchmark")


query("contamination_details", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id LIMIT 100")(lambda s, d: contamination.details(table(s, d, "documents").filter("doc_id % 2 = 0").select("doc_id")))


@query("metrics_log", "SELECT step::INT AS step, (step / 4.0)::DOUBLE AS loss FROM (SELECT unnest(range(1, 6)) AS step), (SELECT 1 FROM benchmark LIMIT 1)")
def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "log")
    for step in range(1, 6):
        io.append_log(spark.range(1).select(F.lit(step).alias("step"), F.lit(step / 4).alias("loss")), path)
    return io.read_log(spark, path, "step int, loss double, timestamp string").filter("timestamp is not null").drop("timestamp")


@query("result_cache", "SELECT 'b' || item_id % 4 AS benchmark, count(*) AS n, 1 AS runs FROM benchmark GROUP BY 1")
def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """The second call finds the result of the first."""
    folder, runs = new_path(spark, "cache"), []

    def make() -> DataFrame:
        runs.append(1)
        return items(spark, d).groupBy(F.concat(F.lit("b"), F.col("item_id") % 4).alias("benchmark")).agg(F.count(F.lit(1)).alias("n"))

    for _ in range(2):
        out = io.cached(spark, folder, make, model="m", shots=5)
    return out.withColumn("runs", F.lit(len(runs)))
