import os

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import tables, workdir


def test_tables_are_written_and_discarded(spark):
    table = workdir.materialize(spark.range(5), "numbers")
    assert table.count() == 5 and os.path.isdir(table.work_path)
    workdir.discard(table)
    assert not os.path.exists(table.work_path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        workdir.shared_dir(Session())


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DEALT", (1000, 1 << 20))
    monkeypatch.setattr(tables, "LEAST_PART", 1000)
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/b.parquet")
    big, small = (tables.table(spark, str(tmp_path), n) for n in "ab")
    parts = big.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 5000
    assert "Exchange" not in small._jdf.queryExecution().toString() and sorted(r[0] for r in small.collect()) == list(range(5))
