import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.functions.ordering import numbered
from corpusmill.operators import contamination, dedup, metrics, mixtures, packing, reports, stats, tasks
from corpusmill.sources import io

VOCABULARIES = "/opt/tokenizers"


def test_rows_come_from_the_hub_then_from_a_file(spark, tmp_path):
    schema = "id long, question string"
    (tmp_path / "local.jsonl").write_text("".join(json.dumps({"id": i, "question": f"q{i}"}) + "\n" for i in (3, 1, 2)))
    local, hub = str(tmp_path / "local.jsonl"), str(tmp_path / "hub")
    ask = lambda **more: [r["question"] for r in io.load_rows(spark, hub, local, schema, lambda rows: rows.select("question"), key="id", **more).collect()]
    assert sorted(ask()) == ["q1", "q2", "q3"] and ask(max_samples=2) == ["q1", "q2"]
    spark.createDataFrame([(9, "hub")], schema).write.parquet(f"{hub}/validation")
    assert ask() == ["hub"]
    assert io.load_rows(spark, str(tmp_path / "none"), None, schema).collect() == []
    with pytest.warns(UserWarning):
        assert io.read_instructions(spark, str(tmp_path / "none"), schema) is None
    assert io.read_instructions(spark, local, schema).count() == 3


def test_loaded_task_equals_its_sql_on_odd_items(spark, tmp_path):
    rows = [(None, "first"), *[(i, "Erß" if i % 2 else "ﬁnǆ") for i in range(20)], (-1, None), (20, ""), (21, "y" * 20_000_001), (22, "\U0001f600ᾳ\u0149"), (23, "\x00\r\n")]
    table = str(tmp_path / "benchmark.parquet")
    for part in (rows, rows[:3]):
        spark.createDataFrame(part, "item_id long, text string").write.mode("overwrite").parquet(table)
        want = duckdb.sql(entry.oracle_sql()["task_load"].replace("benchmark", f"'{table}/*.parquet'")).fetchall()
        assert [tuple(r) for r in entry.queries()["task_load"](spark, str(tmp_path)).collect()] == want
        assert want[-1] == ((23, "\x00\r\n") if part is rows else (None, "FIR"))


def test_tasks_that_are_to_run(spark):
    rows = [("a", True, None, "x"), ("b", False, None, "x"), ("c", None, "here", "x"), ("d", True, "gone", "x"), ("e", True, None, "y")]
    catalogue = spark.createDataFrame(rows, "name string, enabled boolean, path string, `group` string")
    there = spark.createDataFrame([("here",), ("here",)], "path string")
    names = lambda t: sorted(r["name"] for r in t.collect())
    assert names(tasks.select_tasks(catalogue)) == ["a", "c", "d", "e"]
    assert names(tasks.select_tasks(catalogue, there)) == ["a", "c", "e"] and names(tasks.select_tasks(catalogue, there, "y")) == ["e"]
    labels = spark.createDataFrame([("b",), ("a",), ("b",)], "gold string")
    assert tasks.gold_options(labels) == ["a", "b"]
    with pytest.raises(ValueError):
        tasks.gold_options(spark.range(tasks.MAX_LABELS + 1).select(F.col("id").alias("gold")))


def test_replay_that_fails(spark):
    one = spark.createDataFrame([(0, "")], "doc_id long, text string")

    def broken():
        raise OSError("no network")

    with pytest.raises(OSError):
        mixtures.english_replay(broken, 3)
    assert mixtures.english_replay(broken, 3, allow_fallback=True, empty=one).count() == 1
    assert mixtures.english_replay(lambda: spark.range(10).withColumnRenamed("id", "doc_id"), 3).count() == 3


def flat(spark):
    rows = [("m1", "think_off", "enem", "exams", 0.5), ("m2", "think_off", "enem", "exams", 0.5), ("m1", "think_off", "hate", "safety", None), ("m2", "think_off", "hate", "safety", 0.25), ("m2", "think_on", "enem", "exams", 1.0), ("m1", "think_off", "nli", "nli", 0.75)]
    return spark.createDataFrame(rows, "model string, think_mode string, benchmark string, `group` string, score double")


def test_tables_and_dashboard(spark, tmp_path):
    assert reports.comparison_table(flat(spark)) == (
        "| Benchmark | m1 | m2 |\n|---|---|---|\n| enem | **0.5000** | 0.5000 |\n| hate | — | **0.2500** |\n| nli | **0.7500** | — |\n| **Média** | 0.6250 | 0.3750 |\n"
    )
    assert reports.comparison_table(flat(spark), group="safety").count("\n") == 4
    reports.save_dashboard(flat(spark), str(tmp_path / "d"))
    assert (tmp_path / "d/dashboard.md").read_text().startswith("| Benchmark | m1 | m2 |")
    assert (tmp_path / "d/dashboard.txt").read_text().splitlines()[0].split() == ["model", "benchmark", "score"]
    assert {r["think_mode"] for r in spark.read.option("header", True).csv(str(tmp_path / "d/scores")).collect()} == {"off", "on"}
    seeds = stats.seed_intervals(spark.createDataFrame([("b", 0.5), ("b", 0.7), ("a", 1.0)], "model string, score double"), ["model"])
    lines = reports.seeds_table(seeds, ["model"]).splitlines()
    assert lines[2].startswith("| a | 1.0000 | 0.0000 | 1.0000 | 1.0000 |") and lines[3].startswith("| b | 0.6000 | 0.1414 | -0.6706 | 1.8706 |")


def test_split_and_contamination_sinks(spark, tmp_path):
    splits = dedup.split_by_clusters(spark.createDataFrame([(i, i) for i in range(40)], "doc_id long, cluster_id long"), 0.1, 0.1)
    io.save_splits(splits, str(tmp_path / "s"), dedup.split_stats(splits, 50))
    got = spark.read.json(str(tmp_path / "s/stats")).first()
    assert (got["raw_count"], got["post_filter_count"], got["val_count"]) == (50, 40, 4) and spark.read.parquet(str(tmp_path / "s/splits")).count() == 40
    found = spark.createDataFrame([(1, "enem"), (2, "enem"), (3, "hate")], "doc_id long, benchmark string")
    summary = contamination.summary(spark.range(10), exact=found)
    io.save_contamination(found, str(tmp_path / "c"), summary)
    report = json.loads((tmp_path / "c/full_report.json").read_text())
    assert report["benchmarks"] == {"enem": 2, "hate": 1} and report["methods"] == [{"method": "exact", "n_checked": 10, "n_matches": 3, "rate": 0.3}]
    assert sorted(os.listdir(tmp_path / "c/by_benchmark"))[-2:] == ["benchmark=enem", "benchmark=hate"]


def test_clusters_by_method(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (3, " ".join(base).upper()), (4, "something else"), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda method: {r["doc_id"]: r["cluster_id"] for r in dedup.build_clusters(docs, method).collect()}
    assert get("lsh") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert get("exact") == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}
    with pytest.raises(ValueError):
        dedup.build_clusters(docs, "other")


def test_padding_and_plain_token_lists(spark):
    rows = spark.createDataFrame([(1, [5, 6], [-100, 6]), (2, [], []), (3, [7], [7])], "doc_id long, input_ids array<long>, labels array<long>")
    got = {r["doc_id"]: (r["input_ids"], r["labels"], r["attention_mask"]) for r in packing.padded(rows, 0).collect()}
    assert got == {1: ([5, 6], [-100, 6], [1, 1]), 2: ([0, 0], [-100, -100], [0, 0]), 3: ([7, 0], [7, -100], [1, 0])}
    assert packing.unpacked(rows.withColumnRenamed("input_ids", "tokens")).columns == ["doc_id", "input_ids"]


@pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="no vocabulary files")
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_tokens_of_public_vocabularies(spark, name):
    path, texts = f"{VOCABULARIES}/{name}", ["Hello world, it's 2024!", "", None, "Olá, mundo", "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["tokens"] for r in packing.encode(docs, lambda: packing.load_tokenizer(path)).collect()}
    direct = packing.load_tokenizer(path)
    assert got == {i: list(direct([t or ""])[0]) for i, t in enumerate(texts)}
    if name.startswith("byte"):
        assert got[0] == list(packing.load_tokenizer(f"{VOCABULARIES}/byte_bpe_50k.tiktoken")([texts[0]])[0])


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert all(r["idx"] == r["k"] for r in numbered(df, "k").collect())
    assert numbered(df.limit(0), "k").collect() == []


def test_zipped_by_place_and_p_values(spark):
    zipped = metrics.zip_by_place(spark.createDataFrame([(0, "a"), (1, "b")], "idx long, prediction string"), spark.createDataFrame([(1, "b"), (2, "c")], "idx long, gold string"))
    assert [(r["prediction"], r["gold"]) for r in zipped.collect()] == [("b", "b")]
    one = stats.mcnemar(spark.createDataFrame([(True, False)] * 10 + [(False, True)] * 2, "correct_a boolean, correct_b boolean")).first()
    assert one["p_value"] == pytest.approx(stats.chi2_1_p(one["statistic"]))
    same = spark.createDataFrame([(1.0, 1.0)] * 3, "score_a double, score_b double")
    assert stats.wilcoxon(same).first()["p_value"] == 1.0
    pairs = spark.createDataFrame([(float(i % 5), float(i % 3)) for i in range(40)], "score_a double, score_b double")
    w, d = stats.wilcoxon(pairs).first(), [i % 5 - i % 3 for i in range(40) if i % 5 != i % 3]
    ties = [sum(abs(x) == size for x in d) for size in {abs(x) for x in d}]
    assert w["p_value"] == pytest.approx(stats.wilcoxon_p(w["statistic"], len(d), ties))
