"""Sequential monitoring: spending, boundaries, always-valid and Bayesian rules.

Everything about the data is columns over look rows (experiment, variant, look,
info, effect, std_error).  Each arm is judged by its own looks at the information
they really had: its bounds are solved where its rows are.  A plan made in advance
may be given instead.  Rows without a variant are one arm an experiment.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from veltrial.functions import distributions as dist
from veltrial.functions.special import normal_cdf, normal_ppf

Spending = Callable[[float, float], float]


def obrien_fleming(t: float, alpha: float) -> float:
    t = min(1.0, max(t, 1e-12))
    return 2 * (1 - normal_cdf(normal_ppf(1 - alpha / 2) / math.sqrt(t)))


def pocock(t: float, alpha: float) -> float:
    return alpha * math.log(1 + (math.e - 1) * min(1.0, max(t, 0.0)))


def linear(t: float, alpha: float) -> float:
    return alpha * min(1.0, max(t, 0.0))


def kim_demets(rho: float) -> Spending:
    if rho <= 0:
        raise ValueError("rho must be positive")
    return lambda t, alpha: alpha * min(1.0, max(t, 0.0)) ** rho


SPENDING: dict[str, Spending] = {"obf": obrien_fleming, "pocock": pocock, "linear": linear, "kim-demets-2": kim_demets(2), "kim-demets-3": kim_demets(3)}


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(160)
#: A bound that no path reaches in practice.
FAR = 8.0


def _phi(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _outside(nodes: np.ndarray, mass: np.ndarray, rho: float, s: float, b: float) -> float:
    """Chance to leave (-b, b) at the next look from the masses at the nodes."""
    return float(sum(m * (normal_cdf((-b - rho * x) / s) + normal_cdf((rho * x - b) / s)) for x, m in zip(nodes, mass, strict=True)))


class _Path:
    """Masses of the statistic over quadrature nodes inside the bounds, look by look."""

    def __init__(self, fractions: tuple[float, ...]):
        self.fractions, self.look = fractions, 0
        self.nodes, self.mass = np.zeros(1), np.ones(1)

    def _step(self) -> tuple[float, float]:
        if not self.look:
            return 0.0, 1.0  # the first look starts from nothing
        r = self.fractions[self.look - 1] / self.fractions[self.look]
        return math.sqrt(r), math.sqrt(1 - r)

    def leaves(self, b: float) -> float:
        return _outside(self.nodes, self.mass, *self._step(), b)

    def advance(self, b: float) -> None:
        rho, s = self._step()
        b = min(b, FAR)
        nodes = b * _NODES
        density = (_phi((nodes[:, None] - rho * self.nodes[None, :]) / s) / s) @ self.mass
        self.nodes, self.mass, self.look = nodes, density * b * _WEIGHTS, self.look + 1


@lru_cache(maxsize=256)
def boundaries(fractions: tuple[float, ...], alpha: float = 0.05, spending: str = "obf") -> tuple[float, ...]:
    """Two-sided bounds of |z| at the information fractions: each look spends
    what the spending function allows by then."""
    if abs(fractions[-1] - 1) > 1e-9:
        raise ValueError("fractions must rise strictly and end at 1")
    return spending_bounds(fractions, alpha, spending)


@lru_cache(maxsize=256)
def spending_bounds(fractions: tuple[float, ...], alpha: float = 0.05, spending: str = "obf") -> tuple[float, ...]:
    """The bounds so far; the last look may be short of the full information."""
    if any(b <= a for a, b in zip(fractions, fractions[1:], strict=False)) or not 0 < fractions[0] <= fractions[-1] <= 1 + 1e-9:
        raise ValueError("fractions must rise strictly and end at 1")
    path, out, spent = _Path(fractions), [], 0.0
    for t in fractions:
        target = max(SPENDING[spending](t, alpha) - spent, 0.0)
        lo, hi = 0.0, FAR
        if path.leaves(hi) < target:
            for _ in range(60):
                mid = 0.5 * (lo + hi)
                lo, hi = (mid, hi) if path.leaves(mid) > target else (lo, mid)
        out.append(0.5 * (lo + hi) if lo else FAR)
        path.advance(out[-1])
        spent += target
    return tuple(out)


def exit_probabilities(fractions: tuple[float, ...], bounds: tuple[float, ...]) -> list[float]:
    """Chance of first leaving the bounds at each look, without an effect."""
    path, out = _Path(fractions), []
    for b in bounds:
        out.append(path.leaves(b))
        path.advance(b)
    return out


def adjusted_p_value(z: tuple[float, ...], fractions: tuple[float, ...], spending: str = "obf", tol: float = 1e-4) -> float:
    """Least alpha at which one of the looks crosses its bound."""
    crosses = lambda a: any(abs(x) >= b for x, b in zip(z, boundaries(fractions, a, spending), strict=False))
    lo, hi = math.log(1e-8), math.log(0.999)
    if not crosses(math.exp(hi)):
        return 1.0
    while hi - lo > tol:
        mid = 0.5 * (lo + hi)
        lo, hi = (lo, mid) if crosses(math.exp(mid)) else (mid, hi)
    return math.exp(hi)


def design(spark: SparkSession, fractions: tuple[float, ...], alpha: float = 0.05, spending: str = "obf") -> DataFrame:
    """look, info, boundary, spent."""
    b = boundaries(tuple(fractions), alpha, spending)
    return spark.createDataFrame([(k + 1, float(t), float(x), float(SPENDING[spending](t, alpha))) for k, (t, x) in enumerate(zip(fractions, b, strict=True))], "look int, info double, boundary double, spent double")


def is_reliable(bounds: tuple[float, ...]) -> bool:
    """Is the last bound finite and short of where the solver gives up?"""
    return bool(bounds) and math.isfinite(bounds[-1]) and bounds[-1] < FAR


def looks_so_far(looks: DataFrame) -> WindowSpec:
    """The looks of one arm up to each."""
    keys = [k for k in ("experiment", "variant") if k in looks.columns]
    return Window.partitionBy(*keys).orderBy("look").rowsBetween(Window.unboundedPreceding, 0)


def own_boundaries(looks: DataFrame, alpha: float = 0.05, spending: str = "obf") -> DataFrame:
    """Adds boundary and the alpha spent by then: the bounds of each arm's looks at
    the information they had (NULL where information doesn't rise).  A task solves
    each vector of information that its arms have once."""
    keys = [k for k in ("experiment", "variant") if k in looks.columns]

    @F.pandas_udf("array<double>")
    def solved(vectors: pd.Series) -> pd.Series:
        known: dict[tuple[float, ...], list[float | None]] = {}
        for t in {tuple(map(float, v)) for v in vectors}:
            try:
                known[t] = [*spending_bounds(t, alpha, spending), *(SPENDING[spending](x, alpha) for x in t)]
            except ValueError:
                known[t] = [None] * (2 * len(t))
        return pd.Series([known[tuple(map(float, v))] for v in vectors])

    by_look = Window.partitionBy(*keys).orderBy("look")
    every = by_look.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = looks.withColumn("_info", F.collect_list("info").over(every)).withColumn("_at", F.row_number().over(by_look)).withColumn("_both", solved("_info"))
    at = lambda k: F.element_at("_both", k)
    return rows.withColumn("boundary", at(F.col("_at"))).withColumn("spent", at(F.col("_at") + F.size("_info"))).drop("_info", "_at", "_both")


def monitor(looks: DataFrame, plan: DataFrame | None = None, alpha: float = 0.05, spending: str = "obf") -> DataFrame:
    """Crossings and repeated intervals of look rows against the bounds at their
    own information, or against a plan made in advance (by look number)."""
    w = looks_so_far(looks)
    rows = own_boundaries(looks, alpha, spending) if plan is None else looks.join(plan.select("look", "boundary"), "look")
    rows = rows.withColumn("z", F.try_divide("effect", "std_error")).withColumn("crossed", F.coalesce(F.abs("z") >= F.col("boundary"), F.lit(False)))
    return (
        rows.withColumn("stopped", F.max("crossed").over(w))
        .withColumn("repeated_low", F.col("effect") - F.col("boundary") * F.col("std_error"))
        .withColumn("repeated_high", F.col("effect") + F.col("boundary") * F.col("std_error"))
    )


# ---- always-valid inference ------------------------------------------------


def msprt(effect: Column, std_error: Column, tau: float | Column) -> Column:
    """Mixture likelihood ratio of a normal effect with prior sd tau."""
    v, t2 = std_error * std_error, (F.lit(tau) if isinstance(tau, (int, float)) else tau) ** 2
    return F.sqrt(v / (v + t2)) * F.exp(effect * effect * t2 / (2 * v * (v + t2)))


def msprt_p(effect: Column, std_error: Column, tau: float | Column) -> Column:
    return F.least(F.lit(1.0), 1 / msprt(effect, std_error, tau))


def always_valid_path(looks: DataFrame, tau: float | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds the statistic, its p-value and the running least p-value of the arm.
    Without tau, each arm has the one of least threshold at its last look's error,
    which the plan of looks fixes, not the effect."""
    w = looks_so_far(looks)
    if tau is None:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = looks.withColumn("tau", F.last("std_error").over(whole) * optimal_tau(1.0, alpha))
        return always_valid_path(rows, F.col("tau"), alpha)
    e, s = F.col("effect"), F.col("std_error")
    return looks.withColumn("lambda", msprt(e, s, tau)).withColumn("p", msprt_p(e, s, tau)).withColumn("always_valid_p", F.min("p").over(w)).withColumn("rejected", F.col("always_valid_p") <= alpha)


def rejection_threshold(std_error: float, tau: float, alpha: float) -> float:
    v, t2 = std_error**2, tau**2
    return math.sqrt(2 * v * (v + t2) / t2 * (math.log(1 / alpha) + 0.5 * math.log((v + t2) / v)))


def optimal_tau(std_error: float, alpha: float = 0.05) -> float:
    """tau of the least rejection threshold.  With r = tau^2 / std_error^2 the
    derivative is zero where r = 2 log(1 / alpha) + log(1 + r): Newton's steps."""
    r = gap = 2 * math.log(1 / alpha)
    while abs(gap) > 1e-14 * r:
        gap = (r - 2 * math.log(1 / alpha) - math.log1p(r)) / (1 - 1 / (1 + r))
        r -= gap
    return std_error * math.sqrt(r)


def choose_tau(*, std_error: float | None = None, target_effect: float | None = None, alpha: float = 0.05, rule: str = "threshold") -> float:
    """A constant of the design: from the planned error, or the effect to detect."""
    if rule == "threshold" and std_error:
        return optimal_tau(std_error, alpha)
    if rule == "match" and target_effect:
        return abs(target_effect)
    raise ValueError("threshold needs std_error, match needs target_effect")


# ---- Bayesian rule -----------------------------------------------------------


def posterior(rows: DataFrame, prior_mean: float = 0.0, prior_sd: float = 1.0) -> DataFrame:
    """Normal-normal update: adds posterior_mean, posterior_sd."""
    like, pri = 1 / (F.col("std_error") * F.col("std_error")), F.lit(1 / prior_sd**2)
    return rows.withColumn("posterior_mean", (F.col("effect") * like + F.lit(prior_mean) * pri) / (like + pri)).withColumn("posterior_sd", F.sqrt(1 / (like + pri)))


def decide(rows: DataFrame, *, loss_threshold: float, probability_threshold: float = 0.95, threshold: float = 0.0) -> DataFrame:
    """Adds probability_better, the expected loss of shipping and of keeping, and the action."""
    mu, sd = F.col("posterior_mean"), F.col("posterior_sd")
    phi = F.exp(-mu * mu / (2 * sd * sd)) / math.sqrt(2 * math.pi)
    better, worse = dist.normal_cdf(mu / sd), dist.normal_cdf(-mu / sd)
    out = rows.withColumn("probability_better", dist.normal_cdf((mu - threshold) / sd)).withColumn("loss_ship", sd * phi - mu * worse).withColumn("loss_keep", sd * phi + mu * better)
    sure = F.greatest(F.col("probability_better"), 1 - F.col("probability_better")) >= probability_threshold
    stop = sure | (F.least("loss_ship", "loss_keep") <= loss_threshold)
    return out.withColumn("action", F.when(~stop, "continue").when(F.col("loss_ship") <= F.col("loss_keep"), "ship").otherwise("keep"))
