"""Training telemetry: cumulative throughput, plateau stop, forgetting, learning-rate sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def throughput(steps: DataFrame, tokens: str = "tokens", run: str = "run") -> DataFrame:
    """cumulative_tokens and tokens_per_sec per step; runs are apart."""
    w = Window.partitionBy(run).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumns({"cumulative_tokens": F.sum(tokens).over(w), "tokens_per_sec": F.try_divide(tokens, "elapsed")})


def plateau_stop(losses: DataFrame, threshold: float, patience: int, run: str = "run") -> DataFrame:
    """run, best, stop_step: the first step at which patience losses in a row were no better than best - threshold.

    A fold over a run's losses in order; null if it never stops.
    """
    ordered = losses.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("step", F.col("loss").cast("double").alias("loss")))).alias("l"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop"))

    def fold(a, x):
        better = x["loss"] < a["best"] - threshold
        wait = F.when(better, 0).otherwise(a["wait"] + 1)
        stopped = F.coalesce(a["stop"], F.when(wait >= patience, x["step"].cast("long")))
        return F.when(a["stop"].isNotNull(), a).otherwise(F.struct(F.when(better, x["loss"]).otherwise(a["best"]).alias("best"), wait.alias("wait"), stopped.alias("stop")))

    return ordered.select(run, F.aggregate("l", start, fold).alias("s")).select(run, F.col("s.best").alias("best"), F.col("s.stop").alias("stop_step"))


def forgetting(losses: DataFrame, ratio: float = 1.2, run: str = "run") -> DataFrame:
    """perplexity, delta from the run's first, and alert if it is over ratio times that."""
    first = Window.partitionBy(run).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = losses.withColumn("perplexity", F.exp(F.least("loss", F.lit(100.0))))
    p = p.withColumn("baseline", F.first("perplexity").over(first))
    return p.withColumns({"delta": F.col("perplexity") - F.col("baseline"), "alert": F.col("perplexity") > F.col("baseline") * ratio})


def best_lr(logs: DataFrame, run: str = "lr") -> DataFrame:
    """run, final_loss: the last evaluation loss, else the last training loss, else 999; the least first."""
    last = logs.groupBy(run).agg(F.coalesce(F.max_by("eval_loss", F.when(F.col("eval_loss").isNotNull(), F.col("step"))), F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))), F.lit(999.0)).alias("final_loss"))
    return last.withColumn("rank", F.row_number().over(Window.orderBy("final_loss", run)))  # one row a run
