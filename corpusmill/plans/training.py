"""Queries over events: telemetry of runs, and event-time windows as an extension.

user_id plays the run, event_id the step and value the loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import telemetry
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table
from corpusmill.sources.workdir import new_path
from corpusmill.streaming import events as stream


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", (F.col("value") / 100).alias("loss"))


query("cumulative_throughput", "SELECT user_id AS run, event_id AS step, event_id % 7 + 1 AS tokens, 2.0::DOUBLE AS elapsed, sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS cumulative_tokens, (event_id % 7 + 1) / 2.0::DOUBLE AS tokens_per_sec FROM events")(
    lambda s, d: telemetry.throughput(runs(s, d).select("run", "step", (F.col("step") % 7 + 1).alias("tokens"), F.lit(2.0).alias("elapsed")))
)
query(
    "plateau_stop",
    """WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS step, value / 100 AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT run, 0::BIGINT AS i, 'inf'::DOUBLE AS best, 0::BIGINT AS wait, NULL::BIGINT AS stop FROM e WHERE i = 1
  UNION ALL SELECT f.run, e.i, CASE WHEN loss < best - 0.01::DOUBLE THEN loss ELSE best END, CASE WHEN loss < best - 0.01::DOUBLE THEN 0 ELSE wait + 1 END, CASE WHEN NOT (loss < best - 0.01::DOUBLE) AND wait + 1 >= 3 THEN step END
  FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1 WHERE f.stop IS NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS k FROM f)
SELECT run, best, stop AS stop_step FROM l WHERE k = 1""",
)(lambda s, d: telemetry.plateau_stop(runs(s, d), 0.01, 3))
query(
    "forgetting_alert",
    "WITH p AS (SELECT user_id AS run, event_id AS step, least(value / 100, 100.0) AS x, first_value(least(value / 100, 100.0)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT run, step, exp(x) > exp(b) * 1.2::DOUBLE AS alert, round(exp(x), 6) AS perplexity, round(exp(x) - exp(b), 6) AS delta FROM p",
)(lambda s, d: telemetry.forgetting(runs(s, d).select("run", "step", "loss")).select("run", "step", "alert", F.round("perplexity", 6).alias("perplexity"), F.round("delta", 6).alias("delta")))
query(
    "best_lr",
    "WITH l AS (SELECT user_id AS run, coalesce(max_by(value / 100, event_id) FILTER (event_type = 'purchase'), max_by(value / 100, event_id), 999.0) AS final_loss FROM events GROUP BY user_id) SELECT run, final_loss, row_number() OVER (ORDER BY final_loss, run)::INT AS rank FROM l",
)(lambda s, d: telemetry.best_lr(events(s, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss"), F.when(F.col("event_type") == "purchase", F.col("value") / 100).alias("eval_loss")), "run"))

# ---- extensions: event-time windows ----------------------------------------

query("events_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: stream.tumbling_counts(events(s, d)))
query("events_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")(lambda s, d: stream.sliding_counts(events(s, d)))
query(
    "events_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
)(lambda s, d: stream.session_counts(events(s, d)))


@query("events_stream", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling counts once more, by Structured Streaming; complete mode, so no window waits for a later event."""
    raw = events(spark, d)
    live = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_path(spark, "stream")
    sink = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    run = stream.tumbling_counts(live).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
