"""Effects at the looks of an experiment, with users, ratios or clusters as what is judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.operators import clusters, inference, looks


def _at_looks(arms: DataFrame) -> DataFrame:
    """Arms of looks as arms of experiments of their own, for ``contrasts``."""
    return arms.withColumn("experiment", F.struct("experiment", "look", "info")).drop("look", "info", "ds")


def _effects(rows: DataFrame) -> DataFrame:
    return rows.select("experiment.*", "variant", "effect", "std_error")


def look_effects(daily: DataFrame, n_looks: int, control: str = "control", estimator: str = "post_only") -> DataFrame:
    """experiment, variant, look, info, effect, std_error of the picked looks of a
    daily layer.  ``post_only`` and ``cuped`` (theta anew at each look) take the
    variant layer, ``ratio_delta`` the ratio layer; ``cluster_level`` and
    ``cluster_cuped`` the cluster layer, where clusters are what is counted, and
    ``unit_level`` the same layer and looks with users as units."""
    if estimator in ("post_only", "cuped", "ratio_delta"):
        sums = looks.RATIO_SUMS if estimator == "ratio_delta" else looks.SUMS
        pairs = inference.contrasts(_at_looks(looks.look_arms(daily, n_looks, sums).where("n > 1")), control)
        return _effects({"post_only": inference.welch, "cuped": inference.cuped, "ratio_delta": inference.ratio_delta}[estimator](pairs))
    return cluster_effects(looks.cluster_looks(daily, n_looks), estimator, control)


def cluster_effects(totals: DataFrame, estimator: str, control: str = "control") -> DataFrame:
    """The same from the rows of ``looks.cluster_looks``."""
    if estimator == "unit_level":
        users = totals.groupBy("experiment", "variant", "look", "info").agg(*[F.sum(m).alias(m) for m in inference.MOMENTS])
        return _effects(inference.welch(inference.contrasts(_at_looks(users.where("n > 1")), control)))
    by_cluster = _at_looks(totals).drop("cluster_id")
    return _effects({"cluster_level": inference.welch, "cluster_cuped": inference.cuped}[estimator](inference.contrasts(clusters.cluster_means(by_cluster), control)))
