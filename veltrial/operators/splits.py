"""Best linear predictor and sorted group effects over repeated sample splits.

In each split a hash of split and id sends a row to the half that fits the proxy
and the outcome models, or to the half that is judged by them.  A split is a few
sums: normal equations of each arm in one pass, two of the regression of the
effect score on the proxy, one of the groups.  Estimates and bounds are the medians
over the splits; a bound at level 1 - alpha / 2 in each split gives 1 - alpha over all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veltrial.functions.special import normal_ppf
from veltrial.operators.ranks import quantiles_by_key


def half(split: Column, key: Column, seed: int = 0) -> Column:
    """0: fits, 1: is judged."""
    text = F.concat_ws(":", F.lit(str(seed)), split.cast("string"), key.cast("string"))
    # the number of the first eight hex digits modulo 2: the eighth digit tells
    return (F.instr(F.lit("13579bdf"), F.substring(F.md5(text), 8, 1)) > 0).cast("int")


def _arm_models(rows: DataFrame, y: str, d: str, features: list[str], ridge: float) -> DataFrame:
    """split, b (coefficients of the treated, then of the controls, each with its intercept)."""
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(terms)
    products = [F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(terms[i] * F.col(y)).alias(f"y{i}") for i in range(k)]
    sums = rows.groupBy("split", F.col(d).cast("int").alias("arm")).agg(*products)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for _, r in pdf.iterrows():
            xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            out[int(r["arm"])] = np.linalg.solve(xx + ridge * np.diag([0.0] + [1.0] * (k - 1)), np.array([r[f"y{i}"] for i in range(k)]))
        if set(out) != {0, 1}:
            return pd.DataFrame({"split": [], "b": []})
        return pd.DataFrame({"split": [pdf["split"].iloc[0]], "b": [[*out[1], *out[0]]]})

    return sums.groupBy("split").applyInPandas(solve, "split int, b array<double>")


def judged(rows: DataFrame, *, y: str, d: str, features: list[str], id_column: str, propensity: str | float, n_splits: int = 20, ridge: float = 0.0, seed: int = 0) -> DataFrame:
    """split, proxy and score of every row in the halves that are judged: the effect
    that the fitted arms predict, and the doubly robust score of the real one."""
    p = F.lit(propensity) if isinstance(propensity, float) else F.col(propensity)
    base = rows.select(F.col(id_column).alias("_id"), F.col(y).cast("double").alias("_y"), F.col(d).cast("double").alias("_d"), p.cast("double").alias("_p"), *features)
    each = base.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("_half", half(F.col("split"), F.col("_id"), seed))
    models = _arm_models(each.where("_half = 0"), "_y", "_d", features, ridge)
    k = len(features) + 1
    fitted = lambda first: F.col("b")[first] + sum((F.col("b")[first + 1 + i] * F.col(f).cast("double") for i, f in enumerate(features)), F.lit(0.0))
    # a row a split: the rows stay where they are
    both = each.where("_half = 1").join(F.broadcast(models), "split").withColumn("_m1", fitted(0)).withColumn("_m0", fitted(k))
    score = F.col("_m1") - F.col("_m0") + F.col("_d") * (F.col("_y") - F.col("_m1")) / F.col("_p") - (1 - F.col("_d")) * (F.col("_y") - F.col("_m0")) / (1 - F.col("_p"))
    return both.select("split", (F.col("_m1") - F.col("_m0")).alias("proxy"), score.alias("score"))


def best_linear_predictor(scored: DataFrame) -> DataFrame:
    """split, n, effect (mean), slope of the score on the centred proxy, and their
    errors (HC1): slope 1 is a proxy on the right scale, 0 one without signal."""
    s = scored.groupBy("split").agg(F.count("*").alias("n"), F.avg("proxy").alias("_mt"), F.avg("score").alias("effect"), F.covar_samp("proxy", "score").alias("_c"), F.var_samp("proxy").alias("_v"))
    s = s.withColumn("slope", F.try_divide("_c", "_v"))
    t = F.col("proxy") - F.col("_mt")
    e = F.col("score") - F.col("effect") - F.col("slope") * t
    meat = scored.join(F.broadcast(s), "split").groupBy("split").agg(F.sum(t * t * e * e).alias("_tt"), F.sum(e * e).alias("_ee"))
    n = F.col("n")
    wide = F.sqrt(n / (n - 2))
    return s.join(F.broadcast(meat), "split").select("split", "n", "effect", (F.sqrt("_ee") / n * wide).alias("effect_se"), "slope", F.when(F.col("_v") > 0, F.sqrt("_tt") / ((n - 1) * F.col("_v")) * wide).alias("slope_se"))


def sorted_groups(scored: DataFrame, n_groups: int = 4) -> DataFrame:
    """split, group (1 has the lowest proxies), n, effect, std_error of the score;
    groups are cut at the proxy's exact quantiles, equal proxies stay together."""
    cuts = quantiles_by_key(scored, ["split"], "proxy", [k / n_groups for k in range(1, n_groups)], few_keys=True).groupBy("split").agg(F.array_sort(F.collect_list("quantile")).alias("_cuts"))
    above = sum(((F.col("proxy") > F.col("_cuts")[k]).cast("int") for k in range(n_groups - 1)), F.lit(1))
    placed = scored.join(F.broadcast(cuts), "split").withColumn("group", above)  # a row a split
    return placed.groupBy("split", "group").agg(F.count("*").alias("n"), F.avg("score").alias("effect"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("std_error"))


def over_splits(rows: DataFrame, by: list[str], value: str, error: str, alpha: float = 0.05) -> DataFrame:
    """by, splits, estimate, low, high: medians over the splits."""
    z = normal_ppf(1 - alpha / 4)
    middle = lambda c: F.percentile(c, 0.5)
    return rows.groupBy(*by).agg(F.count("*").alias("splits"), middle(F.col(value)).alias("estimate"), middle(F.col(value) - z * F.col(error)).alias("low"), middle(F.col(value) + z * F.col(error)).alias("high"))
