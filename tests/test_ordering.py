import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ordering


def brute(rows, budget):
    before, last, total = 0, None, 0
    for o, k, v in sorted(rows):
        if before < budget:
            last, total = (o, k), before + v
        before += v
    return last, total


@pytest.mark.parametrize("small", [10_000, 3])
def test_cut_equals_running_sums(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL", small)
    monkeypatch.setattr(ordering, "RANGES", 8)
    rng = random.Random(small)
    rows = [(rng.choice([rng.randrange(50), rng.randrange(10**15), -rng.randrange(10**6)]), i, rng.randrange(4)) for i in range(200)] + [(7, i, 2) for i in range(500, 520)]
    df = spark.createDataFrame(rows, "order_key long, k long, v long").repartition(3)
    total = sum(v for *_, v in rows)
    for budget in (0, 1, 2, total // 3, total // 2, total - 1, total, total + 1, 10 * total):
        last, upto = brute(rows, budget)
        got = ordering.cut(df, "v", budget, "k")
        assert ((got.order, got.key) if got.order is not None else None) == last and got.total == upto
        kept = {r["k"] for r in df.filter(got.upto(F.col("order_key"), F.col("k"))).collect()}
        assert kept == ({k for o, k, _ in rows if (o, k) <= last} if last else set())


def test_cut_of_nothing(spark):
    assert ordering.cut(spark.createDataFrame([], "order_key long, k long, v long"), "v", 5, "k").order is None


def test_first_rows_by_numbers_and_strings(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL", 5)
    keys = [f"doc_{i:05d}" for i in range(60)] + ["é", "", "zz", "doc"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n long").repartition(3)
    for n in (0, 1, 10, 63, 64, 100):
        assert sorted(r["k"] for r in ordering.first_rows(df, n, "k").collect()) == sorted(sorted(keys, key=lambda k: k.encode())[:n])
        assert sorted(r["n"] for r in ordering.first_rows(df, n, "n").collect()) == list(range(min(n, 64)))
