"""Experiment sources over a plain events table (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltrial.schemas import EXPERIMENT_CONFIG, GUARDRAIL_CONFIG

METRIC_EVENT = "purchase"
WINDOW_DAYS = 7


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two experiments over the events: exp_a, randomised by user with staggered
    entry, and exp_city, randomised by city; a tenth of the users have no city."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    user, key = F.col("user_id"), F.col("user_id").cast("string")
    city = F.when(user % 10 == 9, F.lit(None)).otherwise(F.concat(F.lit("c"), (user % 10).cast("string")))
    arm = lambda control: F.when(control, "control").otherwise("treatment")

    def exposed(experiment: str, rows: DataFrame, variant) -> DataFrame:
        return rows.select(F.to_date("ts").alias("ds"), F.col("ts").cast("timestamp").alias("ts"), key.alias("user_id"), F.lit(experiment).alias("experiment"), variant.alias("variant"), F.lit("default").alias("layer"))

    return {
        "exposure_log": exposed("exp_a", events.where(F.dayofmonth("ts") >= 8 + user % 14), arm((user * 7 + 3) % 11 < 5)).unionByName(
            exposed("exp_city", events.where((F.dayofmonth("ts") >= 10) & (user % 10 < 9)), arm(user % 10 % 2 == 0))
        ),
        "event_log": events.select(F.to_date("ts").alias("ds"), key.alias("user_id"), F.col("event_type").alias("event_name"), F.col("value").cast("double").alias("metric_value")),
        "user_profile": events.select(key.alias("user_id"), F.to_date(F.lit("2023-06-01")).alias("reg_ds"), city.alias("city")).distinct(),
        "experiment_config": spark.createDataFrame([(e, v, 0.5, "default", None, None) for e in ("exp_a", "exp_city") for v in ("control", "treatment")], EXPERIMENT_CONFIG),
        "guardrail_config": spark.createDataFrame([("exp_a", "error", "lower_is_better", 0.05)], GUARDRAIL_CONFIG),
    }
