"""Events that restate days already published.

An event may come days after the day of exposure that it counts for.  Exposures
and events are two streams, joined on the user within the day window; watermarks
on both bound the state.  A batch's pairs are added to a log of changes by day of
exposure, and only the days that changed are summed again, from their own part of
the log, and stored over the old ones.  Both steps overwrite by name of batch and
day, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veltrial.plans.warehouse import ARM, variant_daily

USER_SUMS = ("pre_metric", "pre_cnt", "post_metric", "post_cnt")


def changes(first: DataFrame, events: DataFrame, *, metric_event: str, pre_days: int, post_days: int, delay: str) -> DataFrame:
    """Streams first(experiment, variant, user_id, expose_ts), one row a user, and
    events(ts, user_id, event_name, metric_value) -> what each adds to its user:
    an exposure adds the user with zeros, an event its value before or after."""
    first = first.withWatermark("expose_ts", delay)
    events = events.where(F.col("event_name") == metric_event).select(F.col("ts").alias("event_ts"), F.col("user_id").alias("event_user"), "metric_value").withWatermark("event_ts", delay)
    day, seen = F.to_date("expose_ts"), F.to_date("event_ts")
    near = (
        (F.col("user_id") == F.col("event_user"))
        # a day wider than the window: these bound the state, the days below decide
        & (F.col("event_ts") >= F.col("expose_ts") - F.expr(f"INTERVAL {pre_days + 1} DAYS"))
        & (F.col("event_ts") <= F.col("expose_ts") + F.expr(f"INTERVAL {post_days + 1} DAYS"))
        & (seen >= F.date_sub(day, pre_days))
        & (seen < F.date_add(day, post_days))
    )
    before = seen < day
    value = lambda has, c: F.when(has, c).otherwise(0)
    keys = [*ARM, "user_id", day.alias("expose_ds")]
    pairs = first.join(events, near).select(
        *keys, value(before, F.col("metric_value")).cast("double").alias("pre_metric"), value(before, F.lit(1)).cast("long").alias("pre_cnt"), value(~before, F.col("metric_value")).cast("double").alias("post_metric"), value(~before, F.lit(1)).cast("long").alias("post_cnt"),
    )
    zero = [F.lit(0).cast("double" if c.endswith("metric") else "long").alias(c) for c in USER_SUMS]
    return first.select(*keys, *zero).unionByName(pairs)


def store(batch: DataFrame, number: int, target: str) -> list:
    """Add a batch of changes and sum the days that it touches again; returns them."""
    spark = batch.sparkSession
    added = batch.groupBy(*ARM, "user_id", "expose_ds").agg(*[F.sum(c).alias(c) for c in USER_SUMS]).withColumn("batch", F.lit(number))
    added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("expose_ds", "batch").parquet(f"{target}/changes")
    log = spark.read.parquet(f"{target}/changes")
    days = [r[0] for r in log.where(F.col("batch") == number).select("expose_ds").distinct().collect()]  # days of a calendar
    users = log.where(F.col("expose_ds").isin(days)).groupBy(*ARM, "user_id", "expose_ds").agg(*[F.sum(c).alias(c) for c in USER_SUMS])
    variant_daily(users).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ds").parquet(f"{target}/dws_experiment_variant_daily")
    return days


def restate(first: DataFrame, events: DataFrame, target: str, *, metric_event: str, pre_days: int = 14, post_days: int = 14, delay: str = "15 days", **trigger) -> StreamingQuery:
    """Keeps ``target``/dws_experiment_variant_daily true to both streams: equal to
    the batch layer as long as nothing is later than ``delay``."""
    rows = changes(first, events, metric_event=metric_event, pre_days=pre_days, post_days=post_days, delay=delay)

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store(batch, number, target)

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", f"{target}/progress").foreachBatch(merge)
    return (writer.trigger(**trigger) if trigger else writer).start()
