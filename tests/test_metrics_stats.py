import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics, reports, stats


def frame(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"prediction {kind}, gold {kind}")


def test_accuracy_and_macro_f1(spark):
    rows = frame(spark, [("a ", "A"), ("b", "c"), ("c", "c"), (None, "a")])
    assert metrics.accuracy(rows).first().asDict() == {"accuracy": 0.5, "n_correct": 2, "n_total": 4}
    rows = frame(spark, [("x", "x"), ("x", "y"), ("y", "y"), ("z", "x")])
    f1 = [2 / 4, 2 / 3, 0.0]
    assert metrics.macro_f1(rows).first()["macro_f1"] == pytest.approx(sum(f1) / 3)
    assert metrics.accuracy(rows.limit(0)).first()["accuracy"] == 0


def test_correlations(spark):
    rng = random.Random(0)
    x = [rng.randrange(6) for _ in range(40)]
    y = [a + rng.random() * 4 for a in x]
    got = metrics.correlations(frame(spark, [(str(a), str(b)) for a, b in zip(x, y)] + [("n/a", "1")])).first()
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    assert got["n_valid"] == 40 and got["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert metrics.correlations(frame(spark, [("1", "2")])).first()["pearson"] == 0
    assert metrics.correlations(frame(spark, [("1", "2")] * 4)).first()["pearson"] is None


def test_boolq_refusal_rubric(spark):
    rows = frame(spark, [("Sim.", "sim"), ("resposta: não", "nao"), ("talvez", "sim"), ("yes it is", "não")])
    assert metrics.boolq_accuracy(rows).first().asDict() == {"accuracy": 0.5, "n_correct": 2, "n_total": 4, "n_invalid": 1}
    assert metrics.refusal_rate(frame(spark, [("Não posso", ""), ("claro", "")])).first()["refusal_rate"] == 0.5
    assert metrics.rubric_score(frame(spark, [("a b", "a c"), ("x", "")])).first()["rubric_score"] == 0.25
    assert metrics.rubric_score(frame(spark, [("Tem Prazo", "")]), [("prazo", 2.0), ("juiz", 2.0)]).first()["rubric_score"] == 0.5


def test_rouge_and_entities(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert metrics.lcs_length(a, b) == lcs(a, b)
    got = metrics.rouge_l(frame(spark, [("o gato preto", "o cão preto"), ("x", ""), ("", "y")])).first()
    assert got["n_valid"] == 2 and got["rouge_l"] == pytest.approx((2 / 3) / 2)
    spans = "array<struct<start:string,label:string>>"
    got = metrics.entity_micro_f1(frame(spark, [([("a", "x"), ("b", "Y")], [("a", "X")]), ([], [("c", "Z")])], spans)).first()
    assert (got["tp"], got["fp"], got["fn"], got["micro_f1"]) == (1, 1, 1, 0.5)
    with pytest.raises(ValueError):
        metrics.compute("none", None)


def test_wilson_and_quantiles(spark):
    rows = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long").select(*stats.wilson(F.col("k"), F.col("n"))).collect()
    assert tuple(rows[0]) == (0, 0, 0)
    assert [round(x, 4) for x in rows[1]] == [0.5, 0.2366, 0.7634] and round(rows[2][1], 4) == 0.7225
    assert stats.t_quantile(0.95, 2) == pytest.approx(4.302653, abs=1e-5) and stats.t_quantile(0.95, 30) == pytest.approx(2.042272, abs=1e-5)
    assert stats.chi2_1_p(3.841459) == pytest.approx(0.05, abs=1e-6)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(0)
    a = rng.random(60)
    return spark.createDataFrame([(i, float(x), float(x - 0.05 - 0.02 * rng.random())) for i, x in enumerate(a)], "idx long, score_a double, score_b double")


def test_paired_tests(spark, items):
    got = stats.paired_bootstrap(items, 200).first()
    assert got["significant"] and got["prob_a_gt_b"] == 1 and got["ci_lower"] < got["mean_diff"] < got["ci_upper"]
    assert stats.paired_permutation(items, 200).first()["p_value"] == pytest.approx(1 / 201)
    same = items.withColumn("score_b", F.col("score_a"))
    assert stats.paired_permutation(same, 50).first()["p_value"] == 1
    with pytest.raises(ValueError):
        stats.paired_permutation(items.limit(1))
    w = stats.wilcoxon(items).first()
    assert (w["n"], w["w_plus"], w["statistic"]) == (60, 1830.0, 0.0) and stats.wilcoxon_p(0, 60) < 1e-6 and stats.wilcoxon_p(0, 0) == 1
    assert stats.cohens_d(items).first()["interpretation"] == "grande"
    assert tuple(stats.cohens_d(same).first()) == (0.0, "negligível")
    assert stats.cohens_d(items.withColumn("score_b", F.col("score_a") * 0 + 1).withColumn("score_a", F.lit(2.0))).first()["cohens_d"] == math.inf


def test_intervals_narrow_and_repeat(spark, items):
    one = stats.bootstrap_ci(items, 100, value="score_a").first()
    assert one == stats.bootstrap_ci(items.repartition(3), 100, value="score_a").first() or one["ci_lower"] == pytest.approx(stats.bootstrap_ci(items, 100, value="score_a").first()["ci_lower"])
    small = stats.bootstrap_ci(items.filter("idx < 8"), 100, value="score_a").first()
    assert small["ci_upper"] - small["ci_lower"] > one["ci_upper"] - one["ci_lower"]


def test_corrections(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03}
    rows = spark.createDataFrame(list(p.items()), "test string, p_value double")
    assert {r["test"]: round(r["adjusted"], 6) for r in stats.holm(rows).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    assert {r["test"]: round(r["adjusted"], 6) for r in stats.bonferroni(rows).collect()} == {"a": 0.03, "b": 0.12, "c": 0.09}
    one = stats.mcnemar_test(spark.createDataFrame([(True, False)] * 10 + [(False, True)] * 2, "correct_a boolean, correct_b boolean"))
    assert one["statistic"] == pytest.approx(49 / 12) and one["p_value"] == pytest.approx(0.0433, abs=1e-3)
    t = {r["model"]: r for r in stats.seed_intervals(spark.createDataFrame([("m", 0.5), ("m", 0.7), ("k", 0.4)], "model string, score double"), ["model"]).collect()}
    assert t["k"]["ci_lower"] == t["k"]["ci_upper"] == 0.4 and t["m"]["ci_upper"] == pytest.approx(0.6 + 12.7062 * 0.141421 / math.sqrt(2), abs=1e-3)


def test_report_table(spark):
    rows = spark.createDataFrame([("m", 0.5), ("k", None)], "model string, score double")
    assert reports.markdown_table(rows) == "| model | score |\n|---|---|\n| m | 0.5000 |\n| k | — |\n"
