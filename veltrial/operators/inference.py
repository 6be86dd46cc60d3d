"""Inference from sufficient statistics, as columns over summary rows.

An arms table has one row per experiment and arm: n, sum_x, sum_y, sum_xx,
sum_yy, sum_xy (x before, y after exposure).  ``contrasts`` sets every other arm
beside the control; the estimators add columns to that.  Undefined numbers are
NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veltrial.functions import distributions as dist
from veltrial.functions.special import normal_ppf

MOMENTS = ["n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy"]
SRM_ALPHA = 1e-3
BALANCE_ALPHA = 1e-3
WEAK_CORRELATION = 0.10


def moments(y: str | Column, x: str | Column | None = None) -> list[Column]:
    """Aggregates of finite pairs (x, y); without x, x is 0."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.lit(0.0) if x is None else F.col(x) if isinstance(x, str) else x
    y, x = y.cast("double"), x.cast("double")
    inf = F.lit(float("inf"))
    fine = y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x) & (F.abs(y) < inf) & (F.abs(x) < inf)
    total = lambda c: F.coalesce(F.sum(F.when(fine, c)), F.lit(0.0))
    return [F.count(F.when(fine, 1)).alias("n"), total(x).alias("sum_x"), total(y).alias("sum_y"), total(x * x).alias("sum_xx"), total(y * y).alias("sum_yy"), total(x * y).alias("sum_xy")]


def merge(arms: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics add up: the same law as partial and final aggregation."""
    return arms.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def from_result(results: DataFrame) -> DataFrame:
    """Arms table of the warehouse's result table."""
    return results.select(
        "experiment", "variant", F.col("user_cnt").alias("n"), F.col("pre_sum").alias("sum_x"), F.col("post_sum").alias("sum_y"), F.col("pre_sq_sum").alias("sum_xx"), F.col("post_sq_sum").alias("sum_yy"), F.col("pre_post_cross_sum").alias("sum_xy")
    )


def _cov(p: str, a: str, b: str, ab: str) -> Column:
    n = F.col(f"{p}n")
    return F.when(n > 1, (F.col(p + ab) - F.col(p + a) * F.col(p + b) / n) / (n - 1))


def mean_y(p: str = "") -> Column:
    return F.try_divide(F.col(f"{p}sum_y"), F.col(f"{p}n"))


def mean_x(p: str = "") -> Column:
    return F.try_divide(F.col(f"{p}sum_x"), F.col(f"{p}n"))


def var_y(p: str = "") -> Column:
    return _cov(p, "sum_y", "sum_y", "sum_yy")


def var_x(p: str = "") -> Column:
    return _cov(p, "sum_x", "sum_x", "sum_xx")


def cov_xy(p: str = "") -> Column:
    return _cov(p, "sum_x", "sum_y", "sum_xy")


def corr_xy(p: str = "") -> Column:
    vx, vy = var_x(p), var_y(p)
    return F.when((vx > 0) & (vy > 0), cov_xy(p) / F.sqrt(vx * vy))


def ratio(p: str = "") -> Column:
    return F.try_divide(F.col(f"{p}sum_y"), F.col(f"{p}sum_x"))


def ratio_variance(p: str = "") -> Column:
    """Delta-method variance of sum_y / sum_x."""
    r, m = ratio(p), mean_x(p)
    return F.try_divide(F.greatest(var_y(p) - 2 * r * cov_xy(p) + r * r * var_x(p), F.lit(0.0)), F.col(f"{p}n") * m * m)


def contrasts(arms: DataFrame, control: str = "control") -> DataFrame:
    """Each other arm beside the control of its experiment: t_* and c_* columns."""
    values = [c for c in arms.columns if c not in ("experiment", "variant")]
    t = arms.where(F.col("variant") != control).select("experiment", "variant", *[F.col(v).alias(f"t_{v}") for v in values])
    c = arms.where(F.col("variant") == control).select("experiment", *[F.col(v).alias(f"c_{v}") for v in values])
    return t.join(c, "experiment")


def welch_columns(effect: Column, var_t: Column, df_t: Column, var_c: Column, df_c: Column) -> dict[str, Column]:
    """var_*: variances of the two means."""
    total = var_t + var_c
    return {"effect": effect, "std_error": F.sqrt(total), "df": F.try_divide(total * total, F.try_divide(var_t * var_t, df_t) + F.try_divide(var_c * var_c, df_c))}


def with_test(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds t, p_value and the interval to effect, std_error, df.  Without any
    spread p is 1 for no effect and 0 for any."""
    t = F.try_divide("effect", "std_error")
    degenerate = F.col("std_error") == 0
    half = dist.t_ppf(F.lit(1 - alpha / 2), F.col("df")) * F.col("std_error")
    return (
        rows.withColumn("t_statistic", t)
        .withColumn("p_value", F.when(degenerate, F.when(F.col("effect") == 0, 1.0).otherwise(0.0)).otherwise(dist.t_two_sided(F.col("t_statistic"), F.col("df"))))
        .withColumn("_half", F.when(degenerate, F.lit(0.0)).otherwise(half))
        .withColumn("ci_low", F.col("effect") - F.col("_half"))
        .withColumn("ci_high", F.col("effect") + F.col("_half"))
        .drop("_half")
        .withColumn("significant", F.col("p_value") < alpha)
    )


def _select(pairs: DataFrame, columns: dict[str, Column], *more: str) -> DataFrame:
    return pairs.select("experiment", "variant", *more, *[c.alias(n) for n, c in columns.items()])


def welch(pairs: DataFrame) -> DataFrame:
    """Difference of means of y."""
    nt, nc = F.col("t_n"), F.col("c_n")
    columns = welch_columns(mean_y("t_") - mean_y("c_"), var_y("t_") / nt, nt - 1, var_y("c_") / nc, nc - 1)
    return _select(pairs, columns | {"relative_effect": F.try_divide(columns["effect"], mean_y("c_"))})


def two_proportions(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """y is 0 or 1: pooled error for the test, unpooled for the interval."""
    nt, nc = F.col("t_n"), F.col("c_n")
    pt, pc = mean_y("t_"), mean_y("c_")
    pool = (F.col("t_sum_y") + F.col("c_sum_y")) / (nt + nc)
    pooled, own = F.sqrt(pool * (1 - pool) * (1 / nt + 1 / nc)), F.sqrt(pt * (1 - pt) / nt + pc * (1 - pc) / nc)
    z = normal_ppf(1 - alpha / 2)
    rows = _select(pairs, {"effect": pt - pc, "std_error": pooled, "ci_low": pt - pc - z * own, "ci_high": pt - pc + z * own})
    return rows.withColumn("z_statistic", F.try_divide("effect", "std_error")).withColumn("p_value", dist.normal_two_sided(F.col("z_statistic")))


def _pooled(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", *[(F.col(f"t_{m}") + F.col(f"c_{m}")).alias(f"p_{m}") for m in MOMENTS])


def cuped(pairs: DataFrame, theta_source: str = "pooled") -> DataFrame:
    """Adjustment by x with one theta for both arms, from the pooled arms or the
    control; adds the balance of x and what the adjustment gains."""
    src = {"pooled": "p_", "control": "c_"}[theta_source]
    rows = _pooled(pairs)
    theta = F.when(var_x(src) > 0, cov_xy(src) / var_x(src))
    rho = corr_xy("p_")
    adjusted = lambda p: mean_y(p) - theta * (mean_x(p) - mean_x("p_"))
    spread = lambda p: F.greatest(var_y(p) - 2 * theta * cov_xy(p) + theta * theta * var_x(p), F.lit(0.0)) / F.col(f"{p}n")
    columns = welch_columns(adjusted("t_") - adjusted("c_"), spread("t_"), F.col("t_n") - 1, spread("c_"), F.col("c_n") - 1)
    gap = mean_x("t_") - mean_x("c_")
    return _select(
        rows,
        columns
        | {
            "theta": theta,
            "correlation": rho,
            "variance_reduction": rho * rho,
            "se_shrinkage": 1 - F.sqrt(1 - rho * rho),
            "effective_sample_multiplier": F.try_divide(F.lit(1.0), 1 - rho * rho),
            "weak_covariate": F.abs(rho) < WEAK_CORRELATION,
            "pre_gap": gap,
            "pre_gap_z": F.try_divide(gap, F.sqrt(var_x("t_") / F.col("t_n") + var_x("c_") / F.col("c_n"))),
            "relative_effect": F.try_divide(columns["effect"], mean_y("c_")),
            "naive_effect": mean_y("t_") - mean_y("c_"),
        },
    )


def balance(rows: DataFrame) -> DataFrame:
    """Status of the pre-period gap of ``cuped`` rows."""
    return rows.withColumn("pre_gap_p", dist.normal_two_sided(F.col("pre_gap_z"))).withColumn("balance", F.when(F.col("pre_gap_p") < BALANCE_ALPHA, "warn").when(F.col("pre_gap_p").isNull(), "unknown").otherwise("pass"))


def ratio_delta(pairs: DataFrame) -> DataFrame:
    """Difference of sum_y / sum_x with delta-method variances."""
    columns = welch_columns(ratio("t_") - ratio("c_"), ratio_variance("t_"), F.col("t_n") - 1, ratio_variance("c_"), F.col("c_n") - 1)
    return _select(pairs, columns | {"ratio_t": ratio("t_"), "ratio_c": ratio("c_"), "relative_effect": F.try_divide(columns["effect"], ratio("c_"))})


def unit_ratio(users: DataFrame, y: str, x: str) -> DataFrame:
    """The other estimand, for comparison: the mean of each unit's y / x; units
    without x are left out and counted."""
    has = F.col(x) > 0
    return users.groupBy("experiment", "variant").agg(*moments(F.when(has, F.col(y) / F.col(x))), F.count(F.when(~has, 1)).alias("without_x"))


def multivariate_theta(sums: DataFrame, covariates: list[str], ridge: float = 0.0) -> DataFrame:
    """Per experiment: theta for several covariates from pooled moments.

    sums: experiment, n, sum_<a>, sum_<a>_<b> for a <= b over covariates and y.
    The normal equations of an experiment are a few numbers, solved in its own
    task.  The variance of the adjusted y uses the unridged matrix."""
    import numpy as np
    import pandas as pd

    names = [*covariates, "y"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = float(r["n"])
        total = np.array([r[f"sum_{a}"] for a in names], float)
        cross = np.array([[r[f"sum_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] for b in names] for a in names], float)
        cov = cross / n - np.outer(total, total) / n**2
        s, c, v = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
        theta = np.linalg.solve(s + ridge * np.eye(len(s)), c)
        left = v - 2 * theta @ c + theta @ s @ theta
        single = max((c[i] ** 2 / (s[i, i] * v) for i in range(len(s)) if s[i, i] > 0 and v > 0), default=0.0)
        reduction = 1 - left / v if v > 0 else 0.0
        return pd.DataFrame([[r["experiment"], theta.tolist(), float(np.linalg.cond(s)), reduction, single, reduction - single]], columns=["experiment", "theta", "condition_number", "variance_reduction", "best_single_reduction", "extra_reduction"])

    schema = "experiment string, theta array<double>, condition_number double, variance_reduction double, best_single_reduction double, extra_reduction double"
    return sums.groupBy("experiment").applyInPandas(solve, schema)


def ratio_gap(units: DataFrame, other: DataFrame) -> DataFrame:
    """How far the difference of mean unit ratios lies from another estimand's:
    units: arms table of ``unit_ratio``; other: experiment, variant, effect."""
    own = welch(contrasts(units.drop("without_x")))
    gap = F.col("unit_effect") - F.col("effect")
    both = own.select("experiment", "variant", F.col("effect").alias("unit_effect")).join(other.select("experiment", "variant", "effect"), ["experiment", "variant"])
    return both.select("experiment", "variant", "unit_effect", "effect", gap.alias("gap"), F.try_divide(gap, F.abs("effect")).alias("relative_gap"))


def cross_fitted_theta(sums: DataFrame, covariates: list[str], ridge: float = 0.0) -> DataFrame:
    """Per experiment: the variance reduction of theta that is fitted, for each
    fold, to the other folds.  sums: ``cross_sums`` by experiment and fold; the
    other folds are the total less the fold, so no row is read again."""
    import numpy as np
    import pandas as pd

    names = [*covariates, "y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        total = pdf[[f"sum_{a}" for a in names]].to_numpy(float)
        cross = np.zeros((len(pdf), len(names), len(names)))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            cross[:, i, j] = cross[:, j, i] = pdf[f"sum_{a}_{b}"].to_numpy(float)
        mean = total.sum(0) / n.sum()
        s1 = s2 = 0.0  # sums of the adjusted metric and its square
        for k in range(len(pdf)):
            rest_n, rest = n.sum() - n[k], total.sum(0) - total[k]
            cov = (cross.sum(0) - cross[k]) / rest_n - np.outer(rest, rest) / rest_n**2
            v = np.append(-np.linalg.solve(cov[:-1, :-1] + ridge * np.eye(len(covariates)), cov[:-1, -1]), 1.0)
            shift = float(v[:-1] @ mean[:-1])  # y - theta (x - mean of x)
            one = float(v @ total[k])
            s1 += one - n[k] * shift
            s2 += float(v @ cross[k] @ v) - 2 * shift * one + n[k] * shift**2
        size = n.sum()
        var_y = cross[:, -1, -1].sum() / size - mean[-1] ** 2
        left = s2 / size - (s1 / size) ** 2
        return pd.DataFrame([[pdf["experiment"].iloc[0], len(pdf), left, 1 - left / var_y if var_y > 0 else 0.0]], columns=["experiment", "folds", "adjusted_variance", "variance_reduction"])

    return sums.groupBy("experiment").applyInPandas(solve, "experiment string, folds int, adjusted_variance double, variance_reduction double")


def cross_sums(frame: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """n, sum_<a> and sum_<a>_<b> for all a <= b, in one pass."""
    names = list(columns)
    aggs = [F.sum(columns[a]).alias(f"sum_{a}") for a in names]
    aggs += [F.sum(columns[a] * columns[b]).alias(f"sum_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def srm(counts: DataFrame, alpha: float = SRM_ALPHA) -> DataFrame:
    """counts: experiment, variant, n, design_weight -> one row per experiment.
    No units fails; an expected count under 5 warns and has no p-value."""
    w = Window.partitionBy("experiment")
    expected = F.sum("n").over(w) * F.col("design_weight") / F.nullif(F.sum("design_weight").over(w), F.lit(0.0))
    scored = counts.withColumn("_e", expected)
    rows = scored.groupBy("experiment").agg(F.sum("n").alias("units"), F.min("_e").alias("least_expected"), F.sum((F.col("n") - F.col("_e")) * (F.col("n") - F.col("_e")) / F.nullif(F.col("_e"), F.lit(0.0))).alias("chi2"), (F.count("*") - 1).alias("df"))
    p = F.when((F.col("units") > 0) & (F.col("least_expected") >= 5), dist.chi2_sf(F.col("chi2"), F.col("df").cast("double")))
    return rows.withColumn("p_value", p).withColumn("status", F.when(F.col("units") == 0, "fail").when(F.col("p_value").isNull(), "warn").when(F.col("p_value") < alpha, "fail").otherwise("pass"))


def srm_from_weights(counts: DataFrame) -> DataFrame:
    """For weights that nobody declared: shares as they are, ``info``, never a test."""
    w = Window.partitionBy("experiment")
    return counts.select("experiment", "variant", "n", F.try_divide("n", F.sum("n").over(w)).alias("share"), F.lit("info").alias("status"))


def power_columns(rows: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Adds the minimum detectable effect and the power at the seen effect."""
    z = normal_ppf(1 - alpha / 2)
    shift = F.abs(F.try_divide("effect", "std_error"))
    return rows.withColumn("mde", F.lit(z + normal_ppf(power)) * F.col("std_error")).withColumn("power", 1 - dist.normal_cdf(F.lit(z) - shift) + dist.normal_cdf(F.lit(-z) - shift))


def required_total_half(sd: float, mde: float, alpha: float = 0.05, power: float = 0.8, treatment_ratio: float = 0.5) -> int:
    """Half of the total sample that detects ``mde``: the size of an arm for an even split."""
    import math

    z = normal_ppf(1 - alpha / 2) + normal_ppf(power)
    total = (z * sd / mde) ** 2 * (1 / treatment_ratio + 1 / (1 - treatment_ratio))
    return math.ceil(total / 2)
