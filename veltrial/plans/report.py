"""One row per experiment and arm: what the warehouse says about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.operators import guardrails, inference, sequential
from veltrial.operators.effects import look_effects
from veltrial.plans.warehouse import Warehouse


#: Which estimate an experiment is judged by, and which stands beside it, as declared.
PATHS = {
    ("unit", "mean", "cuped"): ("cuped", "post_only"), ("unit", "mean", "post_only"): ("post_only", "cuped"),
    ("cluster", "mean", "cuped"): ("cluster_cuped", "cluster_level"), ("cluster", "mean", "post_only"): ("cluster_level", "unit_level"),
    ("unit", "ratio", "cuped"): ("ratio_delta", None), ("unit", "ratio", "post_only"): ("ratio_delta", None),
}


def monitoring(warehouse: Warehouse, declared: dict[str, tuple[str, str, str]], *, n_looks: int = 5, alpha: float = 0.05, spending: str = "obf", control: str = "control") -> DataFrame:
    """Looks of every declared experiment (its unit, kind of metric and estimator)
    by its own path: the group-sequential bounds of its own information, repeated
    intervals, the always-valid p-value, and the other path's effect beside them."""
    layers = {"ratio_delta": warehouse.dws_experiment_ratio_daily, "cluster_level": warehouse.dws_experiment_cluster_daily, "cluster_cuped": warehouse.dws_experiment_cluster_daily, "unit_level": warehouse.dws_experiment_cluster_daily}
    chosen: dict[tuple[str, str | None], list[str]] = {}
    for experiment, kind in declared.items():
        if kind not in PATHS:
            raise ValueError(f"{experiment}: {kind} isn't one of {sorted(PATHS)}")
        chosen.setdefault(PATHS[kind], []).append(experiment)
    out = None
    for (primary, other), names in chosen.items():
        rows = lambda path: look_effects(layers.get(path, warehouse.dws_experiment_variant_daily).where(F.col("experiment").isin(names)), n_looks, control, path)  # noqa: E731, B023
        judged = sequential.always_valid_path(sequential.monitor(rows(primary), alpha=alpha, spending=spending), None, alpha).withColumn("path", F.lit(primary)).withColumn("beside", F.lit(other))
        if other:
            beside = rows(other).select("experiment", "variant", "look", F.col("effect").alias("beside_effect"), F.col("std_error").alias("beside_std_error"))
            judged = judged.join(beside, ["experiment", "variant", "look"], "left")
        else:
            judged = judged.withColumn("beside_effect", F.lit(None).cast("double")).withColumn("beside_std_error", F.lit(None).cast("double"))
        part = judged.select(
            "experiment", "variant", "look", "info", "path", "effect", "std_error", "z", "boundary", "crossed", "stopped", "repeated_low", "repeated_high", "tau", "always_valid_p", "beside", "beside_effect", "beside_std_error",
        )
        out = part if out is None else out.unionByName(part)
    return out


def experiment_report(warehouse: Warehouse, *, control: str = "control", alpha: float = 0.05, tau: float | None = None, n_looks: int = 5) -> DataFrame:
    """Adjusted and plain effect with their difference explained, power, sample
    ratio, guardrails, always-valid p, and the worst of all as health."""
    results = warehouse.ads_experiment_result
    pairs = inference.contrasts(inference.from_result(results), control)
    adjusted = inference.balance(inference.power_columns(inference.with_test(inference.cuped(pairs), alpha), alpha))
    plain = inference.with_test(inference.welch(pairs), alpha).select("experiment", "variant", F.col("std_error").alias("plain_std_error"), F.col("p_value").alias("plain_p_value"))
    ratio = inference.srm(results.select("experiment", "variant", F.col("user_cnt").alias("n"), "design_weight")).select("experiment", F.col("status").alias("sample_ratio"), F.col("p_value").alias("sample_ratio_p"))
    harm = guardrails.guardrail_harm(warehouse.ads_experiment_guardrail_result, warehouse.sources["guardrail_config"], control=control)
    rails = guardrails.experiment_verdict(guardrails.verdicts(harm, alpha)).select("experiment", F.col("verdict").alias("guardrails"))
    path = sequential.always_valid_path(look_effects(warehouse.dws_experiment_variant_daily, n_looks, control), tau, alpha)
    valid = path.groupBy("experiment", "variant").agg(F.min("p").alias("always_valid_p"))
    rows = adjusted.join(plain, ["experiment", "variant"]).join(ratio, "experiment", "left").join(rails, "experiment", "left").join(valid, ["experiment", "variant"], "left")
    rows = rows.withColumn("guardrails", F.coalesce("guardrails", F.lit("unknown"))).withColumn("covariate_shift", F.col("theta") * F.col("pre_gap"))
    bad = (F.col("sample_ratio") == "fail") | (F.col("guardrails") == "stop")
    odd = (F.col("sample_ratio") == "warn") | (F.col("guardrails") == "watch") | (F.col("balance") == "warn")
    return rows.select(
        "experiment", "variant", "effect", "std_error", "p_value", "ci_low", "ci_high", "naive_effect", "plain_std_error", "plain_p_value", "theta", "covariate_shift", "variance_reduction", "mde", "power",
        "sample_ratio", "sample_ratio_p", "guardrails", "balance", "always_valid_p", F.when(bad, "fail").when(odd, "warn").otherwise("pass").alias("health"),
    )
