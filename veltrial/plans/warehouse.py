"""Layered experiment warehouse as lazy plans.

Sources (cast only) -> one row per experiment, arm and user -> daily additive
sums -> results.  Every layer holds sums and counts alone, so a roll-up is a sum
of sums; means, variances and covariances are columns on top.  Nothing runs
until a table is written or read, and Catalyst sees through all layers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARM = ["experiment", "variant"]
UNKNOWN_CLUSTER = "UNKNOWN"


def first_exposures(exposure_log: DataFrame) -> DataFrame:
    """The earliest exposure of each experiment, arm and user (a partial
    aggregate: repeats never cross the shuffle)."""
    return exposure_log.groupBy(*ARM, "user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("expose_ts")).withColumn("expose_ds", F.to_date("expose_ts"))


def experiment_users(exposure_log: DataFrame, event_log: DataFrame, user_profile: DataFrame, *, metric_event: str, pre_days: int = 14, post_days: int = 14) -> DataFrame:
    """One row per experiment, arm and user: the metric before and from the day
    of exposure.  The event name is filtered before the join; the day window is
    a residual of the equi-join on user_id.  A user without events has zeros."""
    expo = first_exposures(exposure_log).alias("e")
    events = event_log.where(F.col("event_name") == metric_event).select("user_id", "ds", "metric_value").alias("v")
    near = (
        (F.col("v.user_id") == F.col("e.user_id"))
        & (F.col("v.ds") >= F.date_sub("e.expose_ds", pre_days))
        & (F.col("v.ds") < F.date_add("e.expose_ds", post_days))
    )
    before, after = F.col("v.ds") < F.col("e.expose_ds"), F.col("v.ds") >= F.col("e.expose_ds")
    keys = ["experiment", "variant", "user_id", "expose_ds", "expose_ts"]
    windowed = (
        expo.join(events, near, "left")
        .groupBy(*[F.col(f"e.{k}") for k in keys])
        .agg(
            F.sum(F.when(before, F.col("v.metric_value")).otherwise(0.0)).alias("pre_metric"),
            F.sum(F.when(before, 1).otherwise(0)).alias("pre_cnt"),
            F.sum(F.when(after, F.col("v.metric_value")).otherwise(0.0)).alias("post_metric"),
            F.sum(F.when(after, 1).otherwise(0)).alias("post_cnt"),
        )
    )
    profile = user_profile.select("user_id", "city", "reg_ds")
    return windowed.join(profile, "user_id", "left").select("experiment", "variant", "user_id", "expose_ds", "expose_ts", "city", "reg_ds", "pre_metric", "pre_cnt", "post_metric", "post_cnt")


def moment_sums() -> list[Column]:
    """Sums of the post and pre metric and their products.  A user occurs once
    an arm, so counting rows counts users: no distinct, no expansion."""
    return [
        F.count("user_id").alias("user_cnt"),
        F.sum("post_metric").alias("post_sum"),
        F.sum(F.col("post_metric") * F.col("post_metric")).alias("post_sq_sum"),
        F.sum("pre_metric").alias("pre_sum"),
        F.sum(F.col("pre_metric") * F.col("pre_metric")).alias("pre_sq_sum"),
        F.sum(F.col("pre_metric") * F.col("post_metric")).alias("pre_post_cross_sum"),
        F.sum("post_cnt").alias("post_event_cnt"),
        F.sum("pre_cnt").alias("pre_event_cnt"),
    ]


def variant_daily(users: DataFrame) -> DataFrame:
    return users.groupBy(*ARM, F.col("expose_ds").alias("ds")).agg(*moment_sums())


def cluster_daily(users: DataFrame, cluster: str = "city") -> DataFrame:
    return users.groupBy(*ARM, F.coalesce(cluster, F.lit(UNKNOWN_CLUSTER)).alias("cluster_id"), F.col("expose_ds").alias("ds")).agg(*moment_sums())


def roll_up(daily: DataFrame, keys: list[str], drop: tuple[str, ...] = ("ds",)) -> DataFrame:
    """Sum of sums over the days."""
    sums = [c for c in daily.columns if c not in keys and c not in drop]
    return daily.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def sample_cov(n: str, sum_a: str, sum_b: str, sum_ab: str) -> Column:
    """Sample covariance from sums; NULL, not 0, where it is undefined."""
    a, b, ab, c = F.col(sum_a), F.col(sum_b), F.col(sum_ab), F.col(n)
    return F.when(c > 1, (ab - a * b / c) / (c - 1))


def result(daily: DataFrame, config: DataFrame) -> DataFrame:
    """Sums of each arm with the declared design, means, variances, covariance."""
    sums = roll_up(daily.drop("post_event_cnt", "pre_event_cnt"), ARM)
    declared = config.select("experiment", "variant", "design_weight", "layer", "hypothesis", "true_lift")
    return sums.join(declared, ARM, "left").select(
        "experiment", "variant", "layer", "hypothesis", "true_lift", "design_weight", "user_cnt", "pre_sum", "post_sum", "pre_sq_sum", "post_sq_sum", "pre_post_cross_sum",
        F.try_divide("post_sum", "user_cnt").alias("post_mean"),
        F.try_divide("pre_sum", "user_cnt").alias("pre_mean"),
        sample_cov("user_cnt", "post_sum", "post_sum", "post_sq_sum").alias("post_var"),
        sample_cov("user_cnt", "pre_sum", "pre_sum", "pre_sq_sum").alias("pre_var"),
        sample_cov("user_cnt", "pre_sum", "post_sum", "pre_post_cross_sum").alias("pre_post_cov"),
    )


def sample_ratio(results: DataFrame) -> DataFrame:
    """Observed and expected users of each arm, and the experiment's chi-square."""
    w = Window.partitionBy("experiment")
    scored = results.select("experiment", "variant", "user_cnt", (F.sum("user_cnt").over(w) * F.col("design_weight") / F.nullif(F.sum("design_weight").over(w), F.lit(0.0))).alias("expected_cnt"))
    off = F.col("user_cnt") - F.col("expected_cnt")
    expected = F.nullif(F.col("expected_cnt"), F.lit(0.0))
    return scored.select(
        "experiment", "variant", "user_cnt", "expected_cnt",
        (off / expected).alias("relative_deviation"),
        (off * off / expected).alias("chi2_component"),
        (F.count("*").over(w) - 1).alias("degrees_of_freedom"),
        F.sum(off * off / expected).over(w).alias("chi2_statistic"),
    )


def ratio_daily(users: DataFrame) -> DataFrame:
    """y: the metric, x: the events behind it."""
    y, x = F.col("post_metric"), F.col("post_cnt")
    return users.groupBy(*ARM, F.col("expose_ds").alias("ds")).agg(
        F.count("user_id").alias("user_cnt"), F.sum(y).alias("sum_y"), F.sum(x).alias("sum_x"), F.sum(y * y).alias("sum_yy"), F.sum(x * x).alias("sum_xx"), F.sum(y * x).alias("sum_xy")
    )


def guardrail_daily(exposure_log: DataFrame, event_log: DataFrame, guardrail_config: DataFrame, *, post_days: int = 14) -> DataFrame:
    """Declared guardrail events from the day of exposure, by the event's day."""
    declared = guardrail_config.select("experiment", F.col("guardrail").alias("event_name"))
    expo = first_exposures(exposure_log).select(*ARM, "user_id", "expose_ds").join(F.broadcast(declared), "experiment")  # one row a declared guardrail
    names = F.broadcast(declared.select("event_name").distinct())  # other events never reach the shuffle
    events = event_log.select("user_id", "ds", "event_name", "metric_value").join(names, "event_name", "left_semi")
    hit = expo.join(events, ["user_id", "event_name"]).where((F.col("ds") >= F.col("expose_ds")) & (F.col("ds") < F.date_add("expose_ds", post_days)))
    # distinct users a day by two plain aggregates instead of a distinct count
    by_user = hit.groupBy(*ARM, "ds", F.col("event_name").alias("guardrail"), "user_id").agg(F.sum("metric_value").alias("v"), F.sum(F.col("metric_value") * F.col("metric_value")).alias("vv"))
    return by_user.groupBy(*ARM, "ds", "guardrail").agg(F.count("user_id").alias("user_cnt"), F.sum("v").alias("value_sum"), F.sum("vv").alias("value_sq_sum"))


def guardrail_result(daily: DataFrame) -> DataFrame:
    return roll_up(daily, ["experiment", "guardrail", "variant"]).withColumn("value_mean", F.try_divide("value_sum", "user_cnt"))


COVARIATE_SUMS = {
    "pre_metric_sum": ("pre_metric", None), "pre_metric_sq_sum": ("pre_metric", "pre_metric"), "pre_cnt_sum": ("pre_cnt", None), "pre_cnt_sq_sum": ("pre_cnt", "pre_cnt"),
    "pre_metric_pre_cnt_cross_sum": ("pre_metric", "pre_cnt"), "pre_metric_post_cross_sum": ("pre_metric", "post_metric"), "pre_cnt_post_cross_sum": ("pre_cnt", "post_metric"),
    "post_metric_sum": ("post_metric", None), "post_metric_sq_sum": ("post_metric", "post_metric"),
}


def covariate_daily(users: DataFrame) -> DataFrame:
    sums = [F.sum(F.col(a) * F.col(b) if b else F.col(a)).alias(name) for name, (a, b) in COVARIATE_SUMS.items()]
    return users.groupBy(*ARM, F.col("expose_ds").alias("ds")).agg(F.count("user_id").alias("user_cnt"), *sums)


def covariate_result(daily: DataFrame) -> DataFrame:
    cov = lambda a, b, ab: sample_cov("user_cnt", a, b, ab)
    return roll_up(daily, ARM).select(
        "*",
        cov("pre_metric_sum", "pre_metric_sum", "pre_metric_sq_sum").alias("pre_metric_var"),
        cov("pre_cnt_sum", "pre_cnt_sum", "pre_cnt_sq_sum").alias("pre_cnt_var"),
        cov("post_metric_sum", "post_metric_sum", "post_metric_sq_sum").alias("post_metric_var"),
        cov("pre_metric_sum", "pre_cnt_sum", "pre_metric_pre_cnt_cross_sum").alias("pre_metric_pre_cnt_cov"),
        cov("pre_metric_sum", "post_metric_sum", "pre_metric_post_cross_sum").alias("pre_metric_post_cov"),
        cov("pre_cnt_sum", "post_metric_sum", "pre_cnt_post_cross_sum").alias("pre_cnt_post_cov"),
    )


@dataclass
class Warehouse:
    """All layers over a set of sources, as lazy plans; ``write`` stores them."""

    sources: dict[str, DataFrame]
    metric_event: str
    pre_days: int = 14
    post_days: int = 14

    @cached_property
    def dwd_experiment_user(self) -> DataFrame:
        s = self.sources
        return experiment_users(s["exposure_log"], s["event_log"], s["user_profile"], metric_event=self.metric_event, pre_days=self.pre_days, post_days=self.post_days)

    @cached_property
    def dws_experiment_variant_daily(self) -> DataFrame:
        return variant_daily(self.dwd_experiment_user)

    @cached_property
    def ads_experiment_result(self) -> DataFrame:
        return result(self.dws_experiment_variant_daily, self.sources["experiment_config"])

    @cached_property
    def ads_experiment_srm(self) -> DataFrame:
        return sample_ratio(self.ads_experiment_result)

    @cached_property
    def dws_experiment_cluster_daily(self) -> DataFrame:
        return cluster_daily(self.dwd_experiment_user)

    @cached_property
    def dws_experiment_ratio_daily(self) -> DataFrame:
        return ratio_daily(self.dwd_experiment_user)

    @cached_property
    def ads_experiment_ratio_result(self) -> DataFrame:
        return roll_up(self.dws_experiment_ratio_daily, ARM)

    @cached_property
    def dws_experiment_guardrail_daily(self) -> DataFrame:
        return guardrail_daily(self.sources["exposure_log"], self.sources["event_log"], self.sources["guardrail_config"], post_days=self.post_days)

    @cached_property
    def ads_experiment_guardrail_result(self) -> DataFrame:
        return guardrail_result(self.dws_experiment_guardrail_daily)

    @cached_property
    def dws_experiment_covariate_daily(self) -> DataFrame:
        return covariate_daily(self.dwd_experiment_user)

    @cached_property
    def ads_experiment_covariate_result(self) -> DataFrame:
        return covariate_result(self.dws_experiment_covariate_daily)

    TABLES = (
        "dwd_experiment_user", "dws_experiment_variant_daily", "ads_experiment_result", "ads_experiment_srm", "dws_experiment_cluster_daily", "dws_experiment_ratio_daily",
        "ads_experiment_ratio_result", "dws_experiment_guardrail_daily", "ads_experiment_guardrail_result", "dws_experiment_covariate_daily", "ads_experiment_covariate_result",
    )
    #: What each table is built from.
    LINEAGE = {
        "dwd_experiment_user": ("exposure_log", "event_log", "user_profile"),
        "dws_experiment_variant_daily": ("dwd_experiment_user",),
        "ads_experiment_result": ("dws_experiment_variant_daily", "experiment_config"),
        "ads_experiment_srm": ("ads_experiment_result",),
        "dws_experiment_cluster_daily": ("dwd_experiment_user",),
        "dws_experiment_ratio_daily": ("dwd_experiment_user",),
        "ads_experiment_ratio_result": ("dws_experiment_ratio_daily",),
        "dws_experiment_guardrail_daily": ("exposure_log", "event_log", "guardrail_config"),
        "ads_experiment_guardrail_result": ("dws_experiment_guardrail_daily",),
        "dws_experiment_covariate_daily": ("dwd_experiment_user",),
        "ads_experiment_covariate_result": ("dws_experiment_covariate_daily",),
    }

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.TABLES}

    #: Layers that others are built from.
    KEPT = ("dwd_experiment_user", "dws_experiment_variant_daily", "dws_experiment_cluster_daily", "dws_experiment_guardrail_daily")

    def keep(self) -> Warehouse:
        """Let the session keep the layers that others are built from, once they
        are computed (on disk where memory is short; a lost part is computed again)."""
        for name in self.KEPT:
            self.__dict__[name] = getattr(self, name).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        for name in self.KEPT:
            self.__dict__.pop(name).unpersist()

    def write(self, target: str) -> Warehouse:
        """Store every table as Parquet, users first, each later layer read from
        what was stored, so that the large join runs once."""
        spark = next(iter(self.sources.values())).sparkSession
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").partitionBy("experiment").parquet(f"{target}/{name}")
            self.__dict__[name] = spark.read.parquet(f"{target}/{name}")
        return self
