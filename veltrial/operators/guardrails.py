"""Guardrail verdicts in three states: what was not declared or not measured is
``unknown``, never ``pass``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veltrial.functions import distributions as dist
from veltrial.operators.inference import _cov


def guardrail_contrasts(results: DataFrame, control: str = "control") -> DataFrame:
    """t_* and c_* columns of each guardrail of an experiment."""
    sums = results.select("experiment", "guardrail", "variant", F.col("user_cnt").alias("n"), F.col("value_sum").alias("sum_y"), F.col("value_sq_sum").alias("sum_yy"))
    side = lambda p: [F.col(c).alias(p + c) for c in ("n", "sum_y", "sum_yy")]
    t = sums.where(F.col("variant") != control).select("experiment", "guardrail", "variant", *side("t_"))
    c = sums.where(F.col("variant") == control).select("experiment", "guardrail", *side("c_"))
    return t.join(c, ["experiment", "guardrail"])


def guardrail_harm(results: DataFrame, config: DataFrame, *, control: str = "control", scale: str = "absolute") -> DataFrame:
    """Harm of each declared guardrail: the difference of means, signed so that
    worse is positive; ``relative`` divides by the control's mean."""
    pairs = config.join(guardrail_contrasts(results, control), ["experiment", "guardrail"], "left")
    mean_t, mean_c = F.try_divide("t_sum_y", "t_n"), F.try_divide("c_sum_y", "c_n")
    unit = F.lit(1.0) if scale == "absolute" else F.nullif(F.abs(mean_c), F.lit(0.0))
    sign = F.when(F.col("direction") == "lower_is_better", 1.0).when(F.col("direction") == "higher_is_better", -1.0)
    var = lambda p: F.greatest(_cov(p, "sum_y", "sum_y", "sum_yy"), F.lit(0.0)) / F.col(f"{p}n")
    vt, vc = var("t_"), var("c_")
    df = F.try_divide((vt + vc) * (vt + vc), F.try_divide(vt * vt, F.col("t_n") - 1) + F.try_divide(vc * vc, F.col("c_n") - 1))
    return pairs.select("experiment", "guardrail", "variant", "direction", "max_harm", (sign * (mean_t - mean_c) / unit).alias("harm"), (F.sqrt(vt + vc) / unit).alias("std_error"), df.alias("df"))


def verdicts(harm: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the interval at alpha over the experiment's analysable guardrails,
    and the status: fail when all of it is past max_harm, warn when the estimate is."""
    known = F.col("harm").isNotNull() & F.col("std_error").isNotNull() & F.col("max_harm").isNotNull()
    k = F.sum(known.cast("int")).over(Window.partitionBy("experiment"))
    rows = harm.withColumn("alpha_each", F.lit(alpha) / F.greatest(k, F.lit(1)))
    half = F.when(F.col("std_error") == 0, F.lit(0.0)).otherwise(dist.t_ppf(1 - F.col("alpha_each") / 2, F.col("df")) * F.col("std_error"))
    rows = rows.withColumn("_half", half).withColumn("harm_low", F.col("harm") - F.col("_half")).withColumn("harm_high", F.col("harm") + F.col("_half")).drop("_half")
    return rows.withColumn("status", F.when(~known, "unknown").when(F.col("harm_low") > F.col("max_harm"), "fail").when(F.col("harm") > F.col("max_harm"), "warn").otherwise("pass"))


def experiment_verdict(rows: DataFrame) -> DataFrame:
    """stop if one fails, watch if one warns, unknown if nothing is known, else ok."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    return rows.groupBy("experiment").agg(F.when(has("fail"), "stop").when(has("warn"), "watch").when(has("unknown"), "unknown").otherwise("ok").alias("verdict"), F.count("*").alias("guardrails"))
