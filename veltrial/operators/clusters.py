"""Inference for cluster-randomised experiments, from per-cluster sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veltrial.operators.inference import contrasts, cuped, moments, welch


def cluster_totals(daily: DataFrame) -> DataFrame:
    """experiment, variant, cluster_id, n, sum_x, sum_y, sum_yy over all days."""
    return daily.groupBy("experiment", "variant", "cluster_id").agg(F.sum("user_cnt").alias("n"), F.sum("pre_sum").alias("sum_x"), F.sum("post_sum").alias("sum_y"), F.sum("post_sq_sum").alias("sum_yy"))


def mixed_clusters(totals: DataFrame) -> DataFrame:
    """Clusters that hold several arms: the assignment wasn't by cluster."""
    return totals.groupBy("experiment", "cluster_id").agg(F.countDistinct("variant").alias("arms")).where("arms > 1")


def cluster_level(totals: DataFrame, control: str = "control") -> DataFrame:
    """Welch test of cluster means, each cluster counting once; with the mean of
    x beside it, so that ``inference.cuped`` applies to the same contrasts."""
    return welch(contrasts(cluster_means(totals), control))


def cluster_means(totals: DataFrame) -> DataFrame:
    """Arms table over clusters as units."""
    return totals.groupBy("experiment", "variant").agg(*moments(F.col("sum_y") / F.col("n"), F.col("sum_x") / F.col("n")))


def cluster_cuped(totals: DataFrame, control: str = "control") -> DataFrame:
    """Adjustment over cluster means, each cluster counting once."""
    return cuped(contrasts(cluster_means(totals), control))


def pass_through(users: DataFrame, prefix: str = "") -> DataFrame:
    """Clusters and users of each experiment whose name begins with ``prefix``."""
    known = users.where(F.col("experiment").startswith(prefix) & F.col("city").isNotNull())
    return known.groupBy("experiment").agg(F.countDistinct("city").alias("clusters"), F.countDistinct("user_id").alias("users"))


def cluster_counts(totals: DataFrame) -> DataFrame:
    return totals.groupBy("experiment", "variant").agg(F.countDistinct("cluster_id").alias("n"))


def icc(totals: DataFrame) -> DataFrame:
    """Intraclass correlation by analysis of variance, floored at 0, and what it costs."""
    by_cluster = totals.groupBy("experiment", "cluster_id").agg(F.sum("n").alias("n"), F.sum("sum_y").alias("y"), F.sum("sum_yy").alias("yy"))
    s = by_cluster.groupBy("experiment").agg(F.count("*").alias("clusters"), F.sum("n").alias("units"), F.sum(F.col("n") * F.col("n")).alias("_nn"), F.sum("y").alias("_y"), F.sum("yy").alias("_yy"), F.sum(F.col("y") * F.col("y") / F.col("n")).alias("_between"))
    g, n = F.col("clusters"), F.col("units")
    msb = F.try_divide(F.col("_between") - F.col("_y") * F.col("_y") / n, g - 1)
    msw = F.try_divide(F.col("_yy") - F.col("_between"), n - g)
    m0 = F.try_divide(n - F.col("_nn") / n, g - 1)
    rows = s.select("experiment", "clusters", "units", msb.alias("ms_between"), msw.alias("ms_within"), m0.alias("m0"))
    value = F.greatest(F.lit(0.0), F.try_divide(F.col("ms_between") - F.col("ms_within"), F.col("ms_between") + (F.col("m0") - 1) * F.col("ms_within")))
    effect = 1 + (F.col("units") / F.col("clusters") - 1) * F.col("icc")
    return rows.withColumn("icc", value).withColumn("design_effect", effect).withColumn("se_inflation", F.sqrt("design_effect")).withColumn("effective_n", F.col("units") / F.col("design_effect"))


def cluster_robust(totals: DataFrame, control: str = "control") -> DataFrame:
    """Difference of user means with the CR1 sandwich.  Clusters have one arm,
    so a cluster's residual sum is its sum less its size times its arm's mean:
    no row below the cluster is read again."""
    arm = Window.partitionBy("experiment", "variant")
    resid = totals.withColumn("s", F.col("sum_y") - F.col("n") * F.sum("sum_y").over(arm) / F.sum("n").over(arm))
    per_arm = resid.groupBy("experiment", "variant").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("sum_y").alias("y"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    p = contrasts(per_arm, control)
    n1, n0, g = F.col("t_n"), F.col("c_n"), F.col("t_g") + F.col("c_g")
    n = n1 + n0
    b12, b22 = -1 / n0, n / (n1 * n0)
    # sums over both arms of s*s, and over the treated of s*r and r*r with r = s there
    v = b12 * b12 * (F.col("t_ss") + F.col("c_ss")) + 2 * b12 * b22 * F.col("t_ss") + b22 * b22 * F.col("t_ss")
    v = v * F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2)
    return p.select("experiment", "variant", (F.col("t_y") / n1 - F.col("c_y") / n0).alias("effect"), F.sqrt(v).alias("std_error"), F.greatest(g - 2, F.lit(1)).cast("double").alias("df"))


# Webb's six-point weights, and Rademacher's two.
WEIGHTS = {"webb": (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)), "rademacher": (-1.0, 1.0)}


def _arm_sums(rows: DataFrame, keys: list[str], y: Column) -> DataFrame:
    """What the CR1 error needs of each side: sums over clusters of y, y^2, n y, n, n^2."""
    side = lambda t: [F.sum(F.when(F.col("treated") == t, c)).alias(f"{name}{t}") for name, c in (("y", y), ("yy", y * y), ("ny", F.col("n") * y), ("n", F.col("n")), ("nn", F.col("n") * F.col("n")))]
    return rows.groupBy(*keys).agg(*side(1), *side(0), F.count("*").alias("clusters"))


def _effect_and_error(sums: DataFrame) -> DataFrame:
    n1, n0, g = F.col("n1"), F.col("n0"), F.col("clusters")
    m1, m0, n = F.col("y1") / n1, F.col("y0") / n0, n1 + n0
    spread = lambda t, m: F.greatest(F.col(f"yy{t}") - 2 * m * F.col(f"ny{t}") + m * m * F.col(f"nn{t}"), F.lit(0.0))
    v = (spread(1, m1) / (n1 * n1) + spread(0, m0) / (n0 * n0)) * F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2)
    return sums.withColumn("effect", m1 - m0).withColumn("std_error", F.sqrt(v))


def wild_cluster_bootstrap(totals: DataFrame, *, n_bootstrap: int = 999, weights: str = "webb", imposed: bool = True, control: str = "control", seed: int = 0) -> DataFrame:
    """Bootstrap-t over clusters, two arms: experiment, effect, std_error, p_value,
    p_resolution, clusters.

    A cluster's weight in a replicate is a hash of seed, replicate and cluster, so
    no draw is stored.  Every statistic is made of sums over clusters, which are
    added up where the clusters are; n_bootstrap rows an experiment are exchanged,
    however many clusters it has."""
    if n_bootstrap < 99 or weights not in WEIGHTS:
        raise ValueError("at least 99 draws; webb or rademacher weights")
    rows = totals.select("experiment", "cluster_id", F.col("n").cast("double").alias("n"), F.col("sum_y").cast("double").alias("y"), (F.col("variant") != control).cast("int").alias("treated"))
    found = _effect_and_error(_arm_sums(rows, ["experiment"], F.col("y")))
    m1, m0 = F.col("y1") / F.col("n1"), F.col("y0") / F.col("n0")
    both = (F.col("y1") + F.col("y0")) / (F.col("n1") + F.col("n0"))
    models = found.select("experiment", F.col("effect").alias("_effect"), F.col("std_error").alias("_error"), (both if imposed else m1).alias("_m1"), (both if imposed else m0).alias("_m0"), (F.lit(0.0) if imposed else F.col("effect")).alias("_centre"))
    fitted = F.col("n") * F.when(F.col("treated") == 1, F.col("_m1")).otherwise(F.col("_m0"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("cluster_id").cast("string"))), 1, 8), 16, 10).cast("long")
    values = WEIGHTS[weights]
    weight = F.element_at(F.array(*map(F.lit, values)), (draw % len(values) + 1).cast("int"))
    drawn = rows.join(models, "experiment").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))))
    again = _effect_and_error(_arm_sums(drawn, ["experiment", "replicate", "_effect", "_error", "_centre"], fitted + weight * (F.col("y") - fitted)))
    stat = F.coalesce(F.abs(F.try_divide(F.col("effect") - F.col("_centre"), F.col("std_error"))), F.lit(0.0))
    beyond = again.groupBy("experiment").agg(F.count_if(stat >= F.abs(F.col("_effect") / F.col("_error"))).alias("_beyond"))
    return found.join(beyond, "experiment").select("experiment", "effect", "std_error", ((F.col("_beyond") + 1) / (n_bootstrap + 1)).alias("p_value"), F.lit(1 / (n_bootstrap + 1)).alias("p_resolution"), "clusters")
