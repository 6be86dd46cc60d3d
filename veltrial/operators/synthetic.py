"""Synthetic control: a donor-weighted stand-in for one treated unit.

The panel is units x periods, at most MAX_CELLS numbers (a larger one is refused):
every refit needs all of it, so it goes to the tasks once, as a matrix.  What
Spark spreads is the refits of the inference, one row each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def simplex_weights(target: np.ndarray, donors: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative weights with sum 1 of least squared error, by accelerated
    projected gradient.  donors: (periods, donors)."""
    k = donors.shape[1]
    w = np.full(k, 1 / k)
    gram, cross = donors.T @ donors, donors.T @ target
    step = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    point, t = w.copy(), 1.0
    for _ in range(rounds):
        new = _to_simplex(point - step * (gram @ point - cross))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-10:
            return new
        w, t = new, t2
    return w


def _to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


MAX_CELLS = 4_000_000


@dataclass
class Matrix:
    """Outcomes by period and unit; ``start`` is the number of periods before treatment."""

    units: list[str]
    values: np.ndarray
    start: int

    def fit(self, treated: str, skip: str | None = None) -> dict:
        """Weights on the other units, and the gap before and after."""
        at = self.units.index(treated)
        donors = [i for i, u in enumerate(self.units) if i != at and u != skip]
        y, x = self.values[:, at], self.values[:, donors]
        w = simplex_weights(y[: self.start], x[: self.start])
        gap = y - x @ w
        pre, post = (float(np.sqrt((g**2).mean())) for g in (gap[: self.start], gap[self.start :]))
        return {"effect": float(gap[self.start :].mean()), "pre_rmse": pre, "post_rmse": post, "ratio": post / max(pre, 1e-12), "donors": [self.units[i] for i in donors], "weights": w}


def matrix(panel: DataFrame, start: int) -> Matrix:
    """The panel of checked size.  A unit that misses a period is refused."""
    p = panel.select(F.col("unit").cast("string").alias("unit"), "period", F.col("outcome").cast("double").alias("outcome"))
    n = p.count()
    if n > MAX_CELLS:
        raise ValueError(f"{n} cells are more than the {MAX_CELLS} that a synthetic control takes")
    wide = p.toPandas().pivot(index="period", columns="unit", values="outcome").sort_index()
    if wide.isna().any().any():
        raise ValueError("the panel is not balanced")
    return Matrix([str(u) for u in wide.columns], wide.to_numpy(float), int((wide.index < start).sum()))


SCM = "unit string, effect double, pre_rmse double, post_rmse double, ratio double"


def _refits(spark: SparkSession, m: Matrix, jobs: list[tuple[str, str, str | None]]) -> DataFrame:
    """jobs: (name of the row, unit in the treated one's place, unit that is no donor)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = [m.fit(u, s) for u, s in zip(pdf["unit"], pdf["skip"], strict=True)]
            yield pd.DataFrame([[n, f["effect"], f["pre_rmse"], f["post_rmse"], f["ratio"]] for n, f in zip(pdf["name"], fits, strict=True)], columns=["unit", "effect", "pre_rmse", "post_rmse", "ratio"])

    return spark.createDataFrame(jobs, "name string, unit string, skip string").repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, SCM)


def synthetic_control(panel: DataFrame, treated: str, start: int) -> DataFrame:
    """Weights: donor, weight."""
    f = matrix(panel, start).fit(treated)
    return panel.sparkSession.createDataFrame([(d, float(w), f["effect"]) for d, w in zip(f["donors"], f["weights"], strict=True)], "donor string, weight double, effect double")


def placebo_inference(panel: DataFrame, treated: str, start: int) -> DataFrame:
    """A refit with each unit in the treated one's place (the treated unit never
    serves as a donor then); p is the rank of its error ratio."""
    m = matrix(panel, start)
    fits = _refits(panel.sparkSession, m, [(u, u, None if u == treated else treated) for u in m.units])
    whole = Window.partitionBy()  # one row a unit
    own = F.max(F.when(F.col("unit") == treated, F.col("ratio"))).over(whole)
    ranked = fits.withColumn("own", own)
    at_least = F.sum(F.when((F.col("unit") != treated) & (F.col("ratio") >= F.col("own")), 1).otherwise(0)).over(whole)
    return ranked.withColumn("p_value", (1 + at_least) / F.count("*").over(whole)).drop("own")


def leave_one_out(panel: DataFrame, treated: str, start: int) -> DataFrame:
    """The effect without each donor."""
    m = matrix(panel, start)
    return _refits(panel.sparkSession, m, [(u, treated, u) for u in m.units if u != treated])


def time_placebo(panel: DataFrame, treated: str, start: int, split: int) -> DataFrame:
    """Treatment pretended at ``split``, judged on the true period before treatment."""
    return synthetic_control(panel.where(F.col("period") < start), treated, split)
