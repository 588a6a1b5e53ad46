"""Analytics of operational logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickline.operators.quantiles import exact_percentiles


def latency_ms(c: Column) -> Column:
    """"0.261346s" -> 261.346, NULL when malformed."""
    return F.regexp_extract(c, r"^([0-9.]+)s$", 1).try_cast("double") * 1000


def request_counts(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("n_errors"))


def latency_summary(log: DataFrame, by: list[str]) -> DataFrame:
    timed = log.withColumn("ms", latency_ms(F.col("latency")))
    return exact_percentiles(timed, by, "ms", {"p50": 0.5, "p95": 0.95, "max": 1.0})


def last_trigger_with_end(log: DataFrame, trigger: Column, end: Column, by: list[str], task: str = "task_id") -> DataFrame:
    """The latest trigger per group and the first end event of its task at or after it, if any."""
    last = (log.filter(trigger).groupBy(*by)
            .agg(F.max(F.struct("at", "event_id", task)).alias("t"))
            .select(*by, F.col("t.at").alias("triggered_at"), F.col("t.event_id").alias("trigger_id"), F.col(f"t.{task}").alias(task)))
    ends = log.filter(end).select(*by, task, F.col("at").alias("_end"), F.col("status").alias("_status"))
    joined = last.join(ends, [*by, task], "left")
    ok = F.col("_end") >= F.col("triggered_at")
    return (joined.groupBy(*by, "triggered_at", "trigger_id", task)
            .agg(F.min(F.when(ok, F.struct("_end", "_status"))).alias("_e"))
            .select(*by, "triggered_at", "trigger_id", task, F.col("_e._end").alias("ended_at"), F.col("_e._status").alias("end_status")))


def journal_steps(journal: DataFrame, keys: list[str], steps: str = "steps") -> DataFrame:
    """Run journal to a step table with totals per run and over all runs."""
    flat = journal.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.*")
    return (flat.rollup(*keys, "step").agg(F.sum("seconds").alias("seconds"), F.count_if(~F.col("ok")).alias("n_failed"),
                                           F.count(F.lit(1)).alias("n_steps"), F.grouping_id().cast("int").alias("level")))


def announcement_summary(df: DataFrame, by: list[str], label: str, probs: list[str]) -> DataFrame:
    """Announced matches per class and mean confidence."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in ("away", "draw", "home")],
        F.avg(F.greatest(*probs)).alias("mean_confidence"))
