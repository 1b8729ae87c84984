"""Reports over evaluation results: flat rows, pivots, group means, winners, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.io import save_report, write_text

RESULT = "struct<task:string,`group`:string,metric_name:string,metrics:map<string,double>,num_examples:int,inference_time_sec:double,think_mode:string>"


def flatten_results(results: DataFrame) -> DataFrame:
    """results: model_name, benchmarks MAP(mode -> MAP(benchmark -> RESULT)).

    score is the primary metric, else accuracy, else 0.
    """
    modes = results.select(F.col("model_name").alias("model"), F.explode("benchmarks").alias("think_mode", "per"))
    rows = modes.select("model", "think_mode", F.explode("per").alias("benchmark", "r"))
    m = F.col("r.metrics")
    score = F.coalesce(F.try_element_at(m, F.col("r.metric_name")), F.try_element_at(m, F.lit("accuracy")), F.lit(0.0))
    return rows.select("model", "think_mode", "benchmark", F.col("r.group").alias("group"), F.col("r.metric_name").alias("metric"), score.alias("score"), F.col("r.num_examples").alias("n_examples"), F.col("r.inference_time_sec").alias("inference_time"))


def primary_score(flat: DataFrame) -> Column:
    return F.coalesce("score", F.lit(0.0))


def pivot_scores(flat: DataFrame, benchmarks: list[str]) -> DataFrame:
    """(model, think_mode) by benchmark; the values are listed, so no pass is spent on finding them."""
    return flat.groupBy("model", "think_mode").pivot("benchmark", benchmarks).agg(F.first("score"))


def group_pivot(flat: DataFrame, models: list[str]) -> DataFrame:
    return flat.groupBy("group").pivot("model", models).agg(F.avg("score"))


def group_averages(flat: DataFrame) -> DataFrame:
    """Macro averages per model, mode and group."""
    return flat.groupBy("model", "think_mode", "group").agg(F.avg(primary_score(flat)).alias("avg_score"), F.count(F.lit(1)).alias("n_benchmarks"))


def model_ranking(flat: DataFrame) -> DataFrame:
    """position, model, avg_score; ties by name."""
    means = flat.groupBy("model").agg(F.avg("score").alias("avg_score"))
    return means.withColumn("position", F.row_number().over(Window.orderBy(F.desc("avg_score"), "model")))  # one row a model


def best_per_benchmark(flat: DataFrame, mode: str | None = None) -> DataFrame:
    """The best row of each benchmark; of equals the first model, then the first mode.  mode: that mode alone."""
    rows = flat.filter(F.col("think_mode") == mode) if mode else flat
    first = Window.partitionBy("benchmark").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "model", "think_mode")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("benchmark", "model", "think_mode", "score")


def last_per_benchmark(flat: DataFrame) -> DataFrame:
    """One row a model and benchmark, whatever the mode: the last mode wins."""
    return flat.groupBy("model", "benchmark").agg(F.max_by("score", "think_mode").alias("score"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of new, and of old the rows whose key new does not have."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A rendered report; bounded, as a person reads it.  Missing values are dashes."""
    show = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join(show(v) for v in r) + " |\n" for r in rows.limit(limit).collect())


MODE_PREFIX, AVERAGE = "think_", "Média"


def show_mode(mode: Column) -> Column:
    return F.regexp_replace(mode, "^" + MODE_PREFIX, "")


def comparison_cells(flat: DataFrame, mode: str = "think_off", group: str | None = None) -> DataFrame:
    """benchmark, model, score, is_best of one mode: best is the highest score of a benchmark, the first model of equals; a missing score counts as 0."""
    rows = flat.filter(F.col("think_mode") == mode)
    rows = rows if group is None else rows.filter(F.col("group") == group)
    order = Window.partitionBy("benchmark").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "model")
    return rows.withColumn("is_best", F.row_number().over(order) == 1).select("benchmark", "model", "score", "is_best")


def comparison_table(flat: DataFrame, mode: str = "think_off", group: str | None = None) -> str:
    """Markdown: benchmarks by models, the best of a row in bold, dashes for missing ones, and a row of averages over what is there.

    A rendered table is small: a cell for each benchmark and model.
    """
    cells = {(r["benchmark"], r["model"]): r for r in comparison_cells(flat, mode, group).collect()}
    benchmarks, models = (sorted({k[i] for k in cells}) for i in (0, 1))
    lines = ["| Benchmark | " + " | ".join(models) + " |", "|" + "---|" * (len(models) + 1)]
    for b in benchmarks:
        shown = []
        for m in models:
            r = cells.get((b, m))
            value = "—" if r is None or r["score"] is None else f"{r['score']:.4f}"
            shown.append(f"**{value}**" if r is not None and r["is_best"] and value != "—" else value)
        lines.append(f"| {b} | " + " | ".join(shown) + " |")
    means = []
    for m in models:
        there = [r["score"] for (_, model), r in cells.items() if model == m and r["score"] is not None]
        means.append(f"{sum(there) / len(there):.4f}" if there else "—")
    return "\n".join([*lines, f"| **{AVERAGE}** | " + " | ".join(means) + " |"]) + "\n"


def seeds_table(intervals: DataFrame, keys: list[str]) -> str:
    """Markdown of seed intervals (mean, std, n_seeds, ci_lower, ci_upper) in order of the keys, four digits."""
    return markdown_table(intervals.orderBy(*keys).select(*keys, "mean", "std", "ci_lower", "ci_upper", "n_seeds"))


def terminal_table(flat: DataFrame) -> str:
    """The last row of each model and benchmark, as aligned text."""
    rows = [[str(r["model"]), str(r["benchmark"]), "—" if r["score"] is None else f"{r['score']:.4f}"] for r in last_per_benchmark(flat).orderBy("model", "benchmark").collect()]
    table = [["model", "benchmark", "score"], *rows]
    width = [max(len(r[i]) for r in table) for i in range(3)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in table) + "\n"


def save_dashboard(flat: DataFrame, path: str, mode: str = "think_off", group: str | None = None) -> None:
    """dashboard.md (comparison and ranking), dashboard.txt (terminal) and scores/ (CSV of the flat rows) under path."""
    spark = flat.sparkSession
    ranked = markdown_table(model_ranking(flat).orderBy("position").select("position", "model", "avg_score"))
    write_text(spark, f"{path}/dashboard.md", comparison_table(flat, mode, group) + "\n" + ranked)
    write_text(spark, f"{path}/dashboard.txt", terminal_table(flat))
    save_report(flat.withColumn("think_mode", show_mode(F.col("think_mode"))), f"{path}/scores")
