"""Metrics over predictions and gold labels, one row out each; frames have prediction and gold columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import strip, strip_accents, words

# Phrases of refusal, without accents.
REFUSALS = (
    "desculpe", "nao posso", "nao e possivel", "nao vou", "inapropriado", "antietico", "recuso", "me recuso", "nao seria adequado",
    "nao devo", "sorry", "i cannot", "i can't", "i won't", "refuse", "i'm not able", "inappropriate",
)
# Words for yes and no.
YES = ("sim", "s", "yes", "y", "verdadeiro", "true", "correto", "1")
NO = ("nao", "não", "n", "no", "falso", "false", "incorreto", "0")


def _total() -> Column:
    return F.count(F.lit(1))


def accuracy(rows: DataFrame) -> DataFrame:
    """accuracy, n_correct, n_total; both sides stripped and upper-cased.

    n_correct is the whole part of accuracy * n_total in doubles, which can be
    one low, as other reports of this metric have it.
    """
    same = F.upper(strip(F.col("prediction").cast("string"))) == F.upper(strip(F.col("gold").cast("string")))
    hits = F.sum(F.coalesce(same, F.lit(False)).cast("long"))
    t = rows.agg((F.coalesce(hits, F.lit(0)) / F.greatest(_total(), F.lit(1))).alias("accuracy"), _total().alias("n_total"))
    return t.select("accuracy", F.floor(F.col("accuracy") * F.col("n_total")).cast("long").alias("n_correct"), "n_total")


def zip_by_place(predictions: DataFrame, golds: DataFrame, place: str = "idx") -> DataFrame:
    """Predictions and gold labels of the same place; places that one side lacks are left out."""
    return predictions.join(golds, place)


def label_counts(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn over the union of gold and predicted labels, stripped and lower-cased."""
    norm = lambda c: F.lower(strip(F.col(c).cast("string")))
    both = rows.select(norm("prediction").alias("p"), norm("gold").alias("g"))
    one = lambda hit: F.sum(hit.cast("long"))
    cells = both.groupBy("p", "g").agg(_total().alias("n"))  # few rows from here on
    sides = cells.select(F.col("p").alias("label"), (F.col("p") == F.col("g")).alias("hit"), F.lit(True).alias("predicted"), "n").union(cells.select("g", F.col("p") == F.col("g"), F.lit(False), "n"))
    n = lambda c: one(F.when(c, F.col("n")).otherwise(0))
    return sides.groupBy("label").agg(n(F.col("hit") & F.col("predicted")).alias("tp"), n(~F.col("hit") & F.col("predicted")).alias("fp"), n(~F.col("hit") & ~F.col("predicted")).alias("fn"))


def f1(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Column:
    return F.when(F.col(tp) == 0, F.lit(0.0)).otherwise(2 * F.col(tp) / (2 * F.col(tp) + F.col(fp) + F.col(fn)))


def macro_f1(rows: DataFrame) -> DataFrame:
    per = label_counts(rows).withColumn("f1", f1())
    ordered = F.aggregate(F.array_sort(F.collect_list(F.struct("label", "f1"))), F.lit(0.0), lambda a, x: a + x["f1"])
    return per.agg((ordered / _total()).alias("macro_f1"), _total().alias("n_labels"))


def average_rank(column: str, partition: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(partition or [])).orderBy(column)
    same = Window.partitionBy(*(partition or []), column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def _corr(x: str, y: str) -> Column:
    """Pearson's r from sums; null where a side is constant."""
    n = _total().cast("double")
    cov = n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x), n * F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y)
    return F.try_divide(cov, F.sqrt(vx * vy))


def ranks(values: DataFrame, column: str) -> DataFrame:
    """value, rank: average ranks of the distinct values; sums over value counts, not over rows."""
    counts = values.groupBy(F.col(column).alias("value")).agg(_total().alias("n"))
    below = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("value", (F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))


def correlations(rows: DataFrame) -> DataFrame:
    """pearson, spearman, n_valid over pairs that both read as numbers; zeros for fewer than three."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    ok = rows.select(number("prediction").alias("x"), number("gold").alias("y")).filter("x is not null and y is not null")
    rx, ry = ranks(ok, "x"), ranks(ok, "y")
    ranked = ok.join(rx.withColumnsRenamed({"value": "x", "rank": "rx"}), "x").join(ry.withColumnsRenamed({"value": "y", "rank": "ry"}), "y")
    few = _total() < 3
    return ranked.agg(F.when(few, 0.0).otherwise(_corr("x", "y")).alias("pearson"), F.when(few, 0.0).otherwise(_corr("rx", "ry")).alias("spearman"), _total().alias("n_valid"))


def is_refusal(text: Column) -> Column:
    plain = strip_accents(F.lower(text))
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(plain, F.lit(phrase))
    return out


def refusal_rate(rows: DataFrame) -> DataFrame:
    n = F.coalesce(F.sum(is_refusal(F.col("prediction")).cast("long")), F.lit(0))
    return rows.agg((n / F.greatest(_total(), F.lit(1))).alias("refusal_rate"), n.alias("n_refused"), _total().alias("n_total"))


def normalize_bool(raw: Column) -> Column:
    """sim, nao or null: the whole answer, or else its first word, without a leading "resposta:"."""
    text = F.regexp_replace(F.lower(strip(raw)), r"[.!,]+\z", "")
    for prefix in ("resposta:", "answer:", "r:"):
        text = F.when(F.startswith(text, F.lit(prefix)), strip(F.substr(text, F.lit(len(prefix) + 1)))).otherwise(text)
    first = F.get(words(text), F.lit(0))
    return F.when(text.isin(*YES), "sim").when(text.isin(*NO), "nao").when(first.isin(*YES), "sim").when(first.isin(*NO), "nao")


def boolq_accuracy(rows: DataFrame) -> DataFrame:
    """Answers that are no yes or no count as invalid and as wrong."""
    p, g = normalize_bool(F.col("prediction")), normalize_bool(F.col("gold"))
    hits = F.coalesce(F.sum(F.coalesce(p == g, F.lit(False)).cast("long")), F.lit(0))
    return rows.agg((hits / F.greatest(_total(), F.lit(1))).alias("accuracy"), hits.alias("n_correct"), _total().alias("n_total"), F.coalesce(F.sum(p.isNull().cast("long")), F.lit(0)).alias("n_invalid"))


def token_recall(prediction: Column, gold: Column) -> Column:
    """Share of the reference's distinct words that the prediction has; 0 without any."""
    ref = F.array_distinct(words(F.lower(gold)))
    return F.when(F.size(ref) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ref, words(F.lower(prediction)))) / F.size(ref))


def rubric(prediction: Column, criteria: list[tuple[str, float]], max_score: float | None = None) -> Column:
    """Weights of the keywords that are there, over the highest score."""
    top = max(sum(w for _, w in criteria) if max_score is None else max_score, 1.0)
    earned = F.lit(0.0)
    for keyword, weight in criteria:
        if keyword:
            earned = earned + F.when(F.contains(F.lower(prediction), F.lit(keyword.lower())), float(weight)).otherwise(0.0)
    return earned / top


def rubric_score(rows: DataFrame, criteria: list[tuple[str, float]] | None = None, max_score: float | None = None) -> DataFrame:
    score = rubric(F.col("prediction"), criteria, max_score) if criteria else token_recall(F.col("prediction"), F.col("gold"))
    scored = rows.select(score.alias("s"))
    return scored.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("rubric_score"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("raw_score"), F.lit(float(max_score or 1.0)).alias("max_possible"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one wide integer, updated once a word of b."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _rouge_l_f1(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for predictions, golds in pairs:
        out = []
        for p, g in zip(predictions, golds):
            a, b = (g or "").lower().split(), (p or "").lower().split()
            if not a:
                out.append(None)
                continue
            n = lcs_length(a, b) if b else 0
            out.append(2 * n / (len(a) + len(b)) if n else 0.0)
        yield pd.Series(out, dtype="Float64")


def rouge_l_f1(prediction: Column | str, gold: Column | str) -> Column:
    """F1 of the longest common subsequence of lower-case words; null for an empty reference."""
    return F.pandas_udf(_rouge_l_f1, "double")(prediction, gold)


def rouge_l(rows: DataFrame) -> DataFrame:
    scored = rows.select(rouge_l_f1("prediction", "gold").alias("f")).filter("f is not null")
    return scored.agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("rouge_l"), _total().alias("n_valid"))


def entity_micro_f1(rows: DataFrame) -> DataFrame:
    """Counts pooled over rows; prediction and gold are arrays of (start, label) structs, compared as sets."""
    norm = lambda c: F.array_distinct(F.transform(c, lambda e: F.struct(e["start"].alias("s"), F.upper(e["label"]).alias("l"))))
    s = rows.select(norm("prediction").alias("p"), norm("gold").alias("g")).select(F.size(F.array_intersect("p", "g")).alias("tp"), F.size("p").alias("np"), F.size("g").alias("ng"))
    t = s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "np", "ng")])
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return t.select(ratio(F.col("tp"), F.col("np")).alias("precision"), ratio(F.col("tp"), F.col("ng")).alias("recall"), ratio(2 * F.col("tp"), F.col("np") + F.col("ng")).alias("micro_f1"), "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "accuracy": accuracy,
    "macro_f1": macro_f1,
    "pearson": correlations,
    "refusal_rate": refusal_rate,
    "rouge_l": rouge_l,
    "entity_micro_f1": lambda rows: entity_micro_f1(rows).withColumn("entity_micro_f1", F.col("micro_f1")),
    "boolq_accuracy": lambda rows: boolq_accuracy(rows).withColumn("boolq_accuracy", F.col("accuracy")),
    "rubric_score": rubric_score,
}


def compute(name: str, rows: DataFrame) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](rows)
