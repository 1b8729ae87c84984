import hashlib
import math
from collections import Counter

import duckdb
from corpusmill.llm import mixing
from corpusmill.llm.mixing import mix_sources


def copies(key, mean):
    parts, n = max(1, math.ceil(mean / 16)), 0
    for part in range(parts):
        u = int(hashlib.md5((f"mix:{'' if key is None else key}" + (f":part:{part}" if part else "")).encode()).hexdigest()[:13], 16) / 16**13
        j, p = 0, math.exp(-mean / parts)
        total = p
        while total <= u:
            j += 1
            p *= mean / parts / j
            total += p
        n += j
    return n


def rows():
    out = [(i, "big", "t") for i in range(600)] + [(i, "small", "t") for i in range(600, 620)] + [(i, None, None) for i in range(620, 700)]
    return out + [(5, "big", "again"), (None, "big", "t")]


def check(spark, got, means):
    expected = Counter()
    for key, source, text in rows():
        for c in range(copies(key, means[source])) if source in means else ():
            expected[key, source, text, c + 1] += 1
    assert Counter((r["doc_id"], r["source"], r["text"], r["copy"]) for r in got) == expected
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys)


def test_equal_weights_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, 9) for r in rows()], "doc_id long, source string, text string, copy int").repartition(4)
    n = Counter(s for _, s, _ in rows())
    check(spark, mix_sources(docs).collect(), {s: len(rows()) / 3 / k for s, k in n.items()})


def test_given_weights_and_total(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    got = mix_sources(docs, {"big": 1, "small": 3}, total=1000).collect()
    check(spark, got, {"big": 250 / 602, "small": 750 / 20})
    share = sum(r["source"] == "small" for r in got) / len(got)
    assert 0.6 < share < 0.9


def test_columns_with_inner_names(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", i, "x", 1.0, i) for i in range(50)], "doc_id long, source string, `_source` int, `_times` string, shuffle_key double, `_rows` int")
    got = mix_sources(docs)
    assert got.columns == ["doc_id", "source", "_source", "_times", "_rows", "copy", "shuffle_key"]
    assert all(r["_source"] == r["doc_id"] == r["_rows"] for r in got.collect())


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, source string")).collect() == []


def test_large_means_equal_the_sql_twin_and_spread_like_poisson(spark, tmp_path, monkeypatch):
    docs = [(i, "t", "en", "big", 1) for i in range(9000)] + [(9000 + i, "u", "en", "small", 1) for i in range(90)] + [(9990, "v", "en", None, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(mixing.MIX_SQL).fetchall(), key=str)
    for block in (mixing.BLOCK, 3):
        monkeypatch.setattr(mixing, "BLOCK", block)
        got = [tuple(r) for r in mix_sources(table).collect()]
        assert sorted(got, key=str) == want
        assert [r[-1] for r in got] == sorted(r[-1] for r in got)
    times = list(Counter(r[0] for r in got if r[3] == "small").values())  # mean 33.7
    mean = sum(times) / len(times)
    assert 0.6 < sum((t - mean) ** 2 for t in times) / len(times) / mean < 1.6
