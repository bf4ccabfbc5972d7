"""Questions over the trace tables: time in states, load, functions, preemption, metrics, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.monitors import unmatched_ends
from chronoloom.shared import kept


def state_durations(spans: DataFrame) -> DataFrame:
    closed = spans.filter("dur_us IS NOT NULL").groupBy("session_id", "core_id", "track", "executor_id", "task_id", "name")
    return closed.agg(F.sum("dur_us").alias("total_us"), F.count(F.lit(1)).alias("n"), F.max("dur_us").alias("max_us"))


def core_utilization(occupancy: DataFrame, events: DataFrame) -> DataFrame:
    """Busy time of each core against the time its session covers."""
    busy = occupancy.groupBy("session_id", "core_id").agg(F.sum("dur_us").alias("busy_us"))
    span = events.groupBy("session_id").agg((F.max("ts_us") - F.min("ts_us")).alias("span_us"))
    rows = busy.join(span, "session_id").withColumn("busy_us", F.coalesce("busy_us", F.lit(0).cast("long")))
    return rows.select("session_id", "core_id", "busy_us", "span_us", F.when(F.col("span_us") > 0, F.col("busy_us") / F.col("span_us")).alias("busy_share"))


def function_stats(spans: DataFrame) -> DataFrame:
    """Percentiles are exact: the least duration that at least so many of a function's durations do not exceed.
    Durations are counted and put in order by ranges, so no task holds all of a function's."""
    spark = spans.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spans.filter("dur_us IS NOT NULL").groupBy("name", "dur_us").agg(F.count(F.lit(1)).alias("held"))
    ranges = kept(kept(counts, "durations").repartitionByRange(parts, "name", "dur_us").withColumn("range", F.spark_partition_id()), "duration-ranges")
    total = F.sum(F.col("dur_us").cast("decimal(38,0)") * F.col("held"))
    sizes = ranges.groupBy("name", "range").agg(F.sum("held").alias("n"), total.cast("decimal(38,0)").alias("total"), F.max("dur_us").alias("most"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("name", "range", before.alias("before"))
    functions = sizes.groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("max_us"))
    upto = F.sum("held").over(Window.partitionBy("name", "range").orderBy("dur_us"))
    ranked = ranges.withColumn("upto", upto).join(F.broadcast(starts), ["name", "range"]).withColumn("upto", F.col("before") + F.col("upto"))
    at = lambda percent: F.min(F.when(F.col("upto") >= F.expr(f"n - n * {100 - percent} div 100"), F.col("dur_us")))
    found = ranked.join(F.broadcast(functions.select("name", "n")), "name").groupBy("name").agg(at(50).alias("p50_us"), at(95).alias("p95_us"))
    mean = F.col("total").cast("double") / F.col("n")
    return functions.join(found, "name").select("name", "n", mean.alias("mean_us"), "p50_us", "p95_us", "max_us")


def preemption_matrix(spans: DataFrame) -> DataFrame:
    """Per victim and preemptor: how often, and for how long where it has ended."""
    hit = spans.filter("track = 'executor' AND name LIKE 'Preempted%'")
    return hit.groupBy("executor_id", "by_executor_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dur_us"), F.lit(0).cast("long")).alias("total_us"))


def metric_windows(counters: DataFrame, width: str = "1 second", watermark: str | None = None) -> DataFrame:
    """Least, mean and largest value per metric and time window; a stream needs a watermark."""
    rows = counters.withColumn("at", F.timestamp_micros("ts_us"))
    if watermark:
        rows = rows.withWatermark("at", watermark)
    out = rows.groupBy(F.window("at", width), "name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return out.select(F.unix_micros("window.start").alias("start_us"), "name", "n", "min_value", "mean_value", "max_value")


def trace_quality(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """(issue, n): rejects and failed events by reason, clock steps back, ends without a start."""
    bad = parsed.select(F.explode(F.filter(F.array(F.concat(F.lit("reject: "), "reject_reason"), F.concat(F.lit("event: "), "event_parse_error")), lambda x: x.isNotNull())).alias("issue"))
    back = events.withColumn("before", F.lag("ts_us").over(Window.partitionBy("session_id").orderBy("seq"))).filter("ts_us < before").select(F.lit("clock runs back").alias("issue"))
    ends = unmatched_ends(events).select(F.lit("end without start").alias("issue"))
    return bad.union(back).union(ends).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
