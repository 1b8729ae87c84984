"""Confidence intervals, paired tests, effect sizes and corrections; resampling indices are hashes."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusmill.functions.text import hash_order


def wilson(correct: Column, total: Column, level: float = 0.95) -> tuple[Column, Column, Column]:
    """Point, lower and upper end; zeros for no items."""
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)
    p = correct / total
    centre, spread = p + F.lit(z * z) / (2 * total), z * F.sqrt(p * (1 - p) / total + F.lit(z * z) / (4 * total * total))
    below = 1 + F.lit(z * z) / total
    none = lambda c: F.when(total == 0, F.lit(0.0)).otherwise(c)
    return none(p), none(F.greatest(F.lit(0.0), (centre - spread) / below)), none(F.least(F.lit(1.0), (centre + spread) / below))


def resampled(items: DataFrame, draws: int, seed: str, values: list[str]) -> DataFrame:
    """draw, values...: for every draw as many items as there are, with replacement.

    items: idx (0, 1, ... n - 1) and values.  The item at place i of a draw is
    hash(seed, draw, i) mod n, so a draw needs no state.
    """
    n = items.count()
    spark = items.sparkSession
    places = spark.range(draws * n).select(F.floor(F.col("id") / max(n, 1)).cast("long").alias("draw"), (F.col("id") % max(n, 1)).alias("place"))
    chosen = places.select("draw", F.pmod(hash_order(seed, "draw", "place"), F.lit(max(n, 1))).alias("idx"))
    return chosen.join(items.select("idx", *values), "idx").select("draw", *values)


def interval(per_draw: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """mean, std (of the population), ci_lower, ci_upper, n_bootstrap over draws."""
    a = (1 - level) / 2
    return per_draw.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(a)).alias("ci_lower"), F.percentile(value, F.lit(1 - a)).alias("ci_upper"), F.count(F.lit(1)).alias("n_bootstrap"))


def bootstrap_ci(items: DataFrame, draws: int = 2000, level: float = 0.95, seed: str = "boot", value: str = "score") -> DataFrame:
    """For a metric that is the mean of a per-item score."""
    per = resampled(items, draws, seed, [value]).groupBy("draw").agg((F.sum(value) / F.count(F.lit(1))).alias("m"))
    return interval(per, "m", level)


def paired_bootstrap(items: DataFrame, draws: int = 2000, level: float = 0.95, seed: str = "boot") -> DataFrame:
    """Difference of the means of score_a and score_b on the same resampled items."""
    per = resampled(items, draws, seed, ["score_a", "score_b"]).groupBy("draw").agg(((F.sum("score_a") - F.sum("score_b")) / F.count(F.lit(1))).alias("d"))
    a = (1 - level) / 2
    out = per.agg(F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(a)).alias("ci_lower"), F.percentile("d", F.lit(1 - a)).alias("ci_upper"), F.avg((F.col("d") > 0).cast("double")).alias("prob_a_gt_b"))
    return out.withColumn("significant", ~((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)))


def paired_permutation(items: DataFrame, permutations: int = 2000, seed: str = "perm") -> DataFrame:
    """p_value (two-sided, (extreme + 1) / (B + 1)) and mean_diff under random signs; 1 for equal columns."""
    n = items.count()
    if n < 2:
        raise ValueError("two items at least are needed")
    observed = items.agg(F.sum(F.col("score_a") - F.col("score_b")).alias("s"), F.sum((F.col("score_a") != F.col("score_b")).cast("long")).alias("differ")).first()
    # only items that differ matter for the sum
    differ = items.filter("score_a != score_b").select("idx", (F.col("score_a") - F.col("score_b")).alias("d"))
    runs = items.sparkSession.range(permutations).select(F.col("id").alias("draw"))
    signs = differ.select("idx", "d", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("draw"))
    flipped = signs.groupBy("draw").agg(F.sum(F.when(hash_order(seed, "draw", "idx") % 2 == 0, F.col("d")).otherwise(-F.col("d"))).alias("s"))
    extreme = runs.join(flipped, "draw", "left").agg(F.sum((F.abs(F.coalesce("s", F.lit(0.0))) >= abs(observed["s"]) - 1e-12).cast("long")).alias("extreme"))
    p = F.when(F.lit(observed["differ"] == 0), 1.0).otherwise((F.col("extreme") + 1) / (permutations + 1))
    return extreme.select(p.alias("p_value"), F.lit(observed["s"] / n).alias("mean_diff"))


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Both tails of the normal distribution beyond |z|; for single rows of results."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def mcnemar(items: DataFrame) -> DataFrame:
    """b, c, statistic with Edwards' correction and p_value, from booleans correct_a and correct_b; 0 and 1 without discordant pairs."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    t = items.agg(n(F.col("correct_a") & ~F.col("correct_b")).alias("b"), n(~F.col("correct_a") & F.col("correct_b")).alias("c"))
    d = F.abs(F.col("b") - F.col("c")) - 1
    t = t.withColumn("statistic", F.when(F.col("b") + F.col("c") == 0, F.lit(0.0)).otherwise(d * d / (F.col("b") + F.col("c"))))
    return t.withColumn("p_value", F.when(F.col("b") + F.col("c") == 0, F.lit(1.0)).otherwise(two_sided(F.sqrt("statistic"))))


def chi2_1_p(statistic: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2))


def wilcoxon_p(statistic: float, n: int, ties: list[int] = ()) -> float:
    """Two-sided normal approximation with tie correction; 1 without differences."""
    if n == 0:
        return 1.0
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
    return 1.0 if var <= 0 else min(1.0, 2 * NormalDist().cdf((statistic - mean) / math.sqrt(var)))


def mcnemar_test(items: DataFrame) -> dict[str, float]:
    row = mcnemar(items).first()
    return {"statistic": row["statistic"], "p_value": row["p_value"]}


def wilcoxon(items: DataFrame) -> DataFrame:
    """n (non-zero differences), w_plus, w_minus, statistic, p_value; zero differences are left out.

    Ranks come from counts of the distinct absolute differences.  p_value is
    the two-sided normal approximation with tie correction, 1 without
    differences.
    """
    d = items.select((F.col("score_a") - F.col("score_b")).alias("d")).filter("d != 0")
    counts = d.groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("plus"))
    below = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    n, ties = F.col("n").cast("double"), F.coalesce(F.sum(F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0))
    t = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), s(F.col("rank") * F.col("plus")).alias("w_plus"), s(F.col("rank") * (F.col("n") - F.col("plus"))).alias("w_minus"), ties.alias("ties"))
    t = t.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("var", n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(F.greatest("var", F.lit(1e-300)))
    return t.withColumn("p_value", F.when((F.col("n") == 0) | (F.col("var") <= 0), F.lit(1.0)).otherwise(F.least(two_sided(z), F.lit(1.0)))).drop("ties", "var")


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligível").when(size < 0.5, "pequeno").when(size < 0.8, "médio").otherwise("grande")


def cohens_d(items: DataFrame, paired: bool = True) -> DataFrame:
    """cohens_d and interpretation of score_a against score_b."""
    a, b = F.col("score_a"), F.col("score_b")
    n = F.count(F.lit(1))
    if paired:
        mean, sd = F.avg(a - b), F.stddev_samp(a - b)
    else:
        mean, sd = F.avg(a) - F.avg(b), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)  # equal sizes
    t = items.agg(n.alias("n"), mean.alias("m"), F.coalesce(sd, F.lit(0.0)).alias("sd"))
    d = F.when(F.col("n") < 2, 0.0).when((F.col("sd") == 0) & (F.col("m") == 0), 0.0).when(F.col("sd") == 0, F.lit(float("inf"))).otherwise(F.try_divide("m", "sd"))
    label = F.when(F.col("n") < 2, "insuficiente (n < 2)").when((F.col("sd") == 0) & (F.col("m") != 0), "indeterminado (std=0)").otherwise(effect_label(d))
    return t.select(d.alias("cohens_d"), label.alias("interpretation"))


def bonferroni(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """adjusted: min(1, p * tests)."""
    n = tests.agg(F.count(F.lit(1)).alias("_n"))
    return tests.join(F.broadcast(n), F.lit(True)).withColumn("adjusted", F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_n")


def holm(tests: DataFrame, p: str = "p_value", key: str = "test") -> DataFrame:
    """adjusted: running maximum of p * (tests - rank), 1 at most; a table of tests is small."""
    order = Window.orderBy(p, key)
    ranked = tests.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    raw = F.col(p) * (F.col("_n") - F.col("_r"))
    up = F.max(raw).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("adjusted", F.least(up, F.lit(1.0))).drop("_r", "_n")


def t_quantile(level: float, df: int) -> float:
    """Two-sided Student t quantile by bisection on the incomplete beta function."""
    target = 1 - level

    def tail(t: float) -> float:
        return _incomplete_beta(df / (df + t * t), df / 2, 0.5)

    lo, hi = 0.0, 1e7
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > target else (lo, mid)
    return (lo + hi) / 2


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised, by the continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d or 1e-300), 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def seed_intervals(scores: DataFrame, group: list[str], value: str = "score", level: float = 0.95) -> DataFrame:
    """mean, std (ddof 1), n_seeds and t interval per group; one seed gives a degenerate interval."""
    t = scores.groupBy(*group).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    half = t_quantiles(level)("n_seeds") * F.col("std") / F.sqrt("n_seeds")
    return t.withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})


def t_quantiles(level: float):
    """Column function: the two-sided t quantile for a number of values, 0 for one; found once for each number in a batch."""

    @F.pandas_udf(DoubleType())
    def quantile(n: pd.Series) -> pd.Series:
        known = {x: t_quantile(level, x - 1) if x > 1 else 0.0 for x in n.unique()}
        return n.map(known).astype("float64")

    return quantile


def metric_interval(metrics: DataFrame, items: DataFrame, draws: int = 2000, level: float = 0.95) -> DataFrame | None:
    """Wilson's interval if the metric counts correct answers, else a bootstrap for five items or more, else none."""
    if {"n_correct", "n_total"} <= set(metrics.columns):
        point, low, high = wilson(F.col("n_correct"), F.col("n_total"), level)
        return metrics.select(point.alias("mean"), low.alias("ci_lower"), high.alias("ci_upper"))
    if items.limit(5).count() < 5:
        return None
    return bootstrap_ci(items, draws, level).select("mean", "ci_lower", "ci_upper")
