"""Difference-in-differences estimators from per-cohort moments.

A balanced panel is a long table (unit, period 1..T, outcome, cohort: the first
treated period, NULL if never).  Every estimator here is linear in a unit's
outcomes with coefficients that depend on its cohort alone.  So one pass over
the units, which sums each cohort's outcome vectors and their outer products
(T and T*T numbers a cohort, map-side first), is all that Spark has to do;
effects, influence-function variances and joint tests follow from these sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.functions.special import normal_ppf, f_sf, t_ppf, t_two_sided

NEVER = 10**6


@dataclass
class Moments:
    """n, mean (T) and centred outer products (T, T) of each cohort."""

    n: dict[int, int]
    mean: dict[int, np.ndarray]
    spread: dict[int, np.ndarray]
    periods: int

    @property
    def units(self) -> int:
        return sum(self.n.values())

    @property
    def cohorts(self) -> list[int]:
        return sorted(c for c in self.n if c != NEVER)


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        y = np.stack(pdf["y"].to_numpy()).astype(float)
        one = np.c_[np.ones(len(y)), y]
        for c in pdf["cohort"].unique():
            own = one[(pdf["cohort"] == c).to_numpy()]
            total[int(c)] = total.get(int(c), 0) + own.T @ own
    for c, m in total.items():
        i, j = np.indices(m.shape)
        yield pd.DataFrame({"cohort": c, "i": i.ravel(), "j": j.ravel(), "s": m.ravel()})


def moments(panel: DataFrame) -> Moments:
    """One pass.  A unit without exactly one outcome in every period is an error."""
    units = panel.groupBy("unit").agg(F.coalesce(F.max("cohort"), F.lit(NEVER)).cast("long").alias("cohort"), F.array_sort(F.collect_list(F.struct("period", F.col("outcome").cast("double").alias("y")))).alias("rows"))
    shape = units.agg(F.min(F.size("rows")), F.max(F.size("rows")), F.max(F.transform("rows", lambda r: r["period"].cast("long"))[F.size("rows") - 1])).first()
    if shape[0] is None or shape[0] != shape[1] or shape[2] != shape[1]:
        raise ValueError("the panel is empty or not balanced over periods 1..T")
    sums = units.select("cohort", F.transform("rows", lambda r: r["y"]).alias("y")).mapInPandas(_gram, "cohort long, i int, j int, s double").groupBy("cohort", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    size = int(shape[0]) + 1
    n, mean, spread = {}, {}, {}
    for c, own in sums.groupby("cohort"):
        m = np.zeros((size, size))
        m[own["i"], own["j"]] = own["s"]
        n[int(c)] = int(round(m[0, 0]))
        mean[int(c)] = m[0, 1:] / m[0, 0]
        spread[int(c)] = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
    return Moments(n, mean, spread, size - 1)


@dataclass
class Functional:
    """An effect and the influence of a unit of cohort c: slope[c] . y - level[c]."""

    effect: float
    slope: dict[int, np.ndarray] = field(default_factory=dict)
    level: dict[int, float] = field(default_factory=dict)

    def __add__(self, other: Functional) -> Functional:
        keys = set(self.slope) | set(other.slope)
        zero = lambda f, c: f.slope.get(c, 0.0)
        return Functional(self.effect + other.effect, {c: zero(self, c) + zero(other, c) for c in keys}, {c: self.level.get(c, 0.0) + other.level.get(c, 0.0) for c in keys})

    def times(self, w: float) -> Functional:
        return Functional(w * self.effect, {c: w * a for c, a in self.slope.items()}, {c: w * k for c, k in self.level.items()})


def influence_product(a: Functional, b: Functional, m: Moments) -> float:
    """Sum over units of the product of two influences."""
    out = 0.0
    for c in set(a.slope) & set(b.slope):
        out += a.slope[c] @ m.spread[c] @ b.slope[c] + m.n[c] * (a.slope[c] @ m.mean[c] - a.level[c]) * (b.slope[c] @ m.mean[c] - b.level[c])
    return float(out)


def std_error(f: Functional, m: Moments) -> float:
    n = m.units
    return math.sqrt(max(influence_product(f, f, m), 0.0) / (n - 1) / n)


def estimate(f: Functional, m: Moments, alpha: float = 0.05) -> dict[str, float]:
    se, df = std_error(f, m), max(m.units - 1, 1)
    t = f.effect / se if se > 0 else math.nan
    half = t_ppf(1 - alpha / 2, df) * se
    return {"effect": f.effect, "std_error": se, "p_value": t_two_sided(t, df) if se > 0 else float(f.effect == 0), "ci_low": f.effect - half, "ci_high": f.effect + half}


def contrast(m: Moments, cohort: int, period: int, base: int, control: str = "not_yet_treated") -> tuple[Functional, int, int] | None:
    """Change of a cohort from base to period less that of its controls: never
    treated, or not treated by either date; never the cohort itself."""
    pool = [NEVER] if control == "never_treated" else [c for c in m.n if c > max(period, base)]
    pool = [c for c in pool if c != cohort and c in m.n]
    size = sum(m.n[c] for c in pool)
    if cohort not in m.n or size < 2:
        return None
    step = np.zeros(m.periods)
    step[period - 1] += 1
    step[base - 1] -= 1
    treated = float(step @ m.mean[cohort])
    other = sum(m.n[c] * float(step @ m.mean[c]) for c in pool) / size
    p, q = m.units / m.n[cohort], m.units / size
    f = Functional(treated - other, {cohort: p * step}, {cohort: p * treated})
    for c in pool:
        f.slope[c], f.level[c] = -q * step, -q * other
    return f, m.n[cohort], size


def group_time(m: Moments, control: str = "not_yet_treated", include_pre: bool = True) -> dict[tuple[int, int], tuple[Functional, int, int]]:
    """Effects of each cohort and period against the period before treatment."""
    out = {}
    for g in m.cohorts:
        for t in range(1, m.periods + 1):
            if g >= 2 and t != g - 1 and (include_pre or t >= g):
                got = contrast(m, g, t, g - 1, control)
                if got:
                    out[g, t] = got
    return out


def _weighted(parts: list[tuple[Functional, float]]) -> Functional:
    total = sum(w for _, w in parts)
    out = Functional(0.0)
    for f, w in parts:
        out = out + f.times(w / total)
    return out


def event_study(cells: dict[tuple[int, int], tuple[Functional, int, int]]) -> dict[int, Functional]:
    """Effects by periods since treatment, weighted by cohort sizes."""
    by: dict[int, list[tuple[Functional, float]]] = {}
    for (g, t), (f, n, _) in cells.items():
        by.setdefault(t - g, []).append((f, n))
    return {k: _weighted(parts) for k, parts in sorted(by.items())}


def overall(cells: dict[tuple[int, int], tuple[Functional, int, int]]) -> Functional:
    post = [(f, n) for (g, t), (f, n, _) in cells.items() if t >= g]
    if not post:
        raise ValueError("no effect after treatment can be estimated")
    return _weighted(post)


def sun_abraham(m: Moments, control: str = "never_treated", min_k: int | None = None, max_k: int | None = None) -> tuple[dict[int, Functional], Functional]:
    """Interaction-weighted effects by relative period, and over k >= 0."""
    cells = {(g, t): v for (g, t), v in group_time(m, control).items() if (min_k is None or t - g >= min_k) and (max_k is None or t - g <= max_k)}
    return event_study(cells), overall(cells)


def switchers(m: Moments, control: str = "not_yet_treated") -> tuple[Functional, Functional]:
    """Instant effect of those who switch, and the placebo a period earlier."""
    plus, minus = [], []
    for g in m.cohorts:
        if g >= 3:
            pool = [c for c in m.n if (c == NEVER if control == "never_treated" else c > g) and c != g]
            size = sum(m.n[c] for c in pool)
            if size < 2:
                continue
            for out, (t, b) in ((plus, (g, g - 1)), (minus, (g - 1, g - 2))):
                step = np.zeros(m.periods)
                step[t - 1], step[b - 1] = 1.0, -1.0
                treated, other = float(step @ m.mean[g]), sum(m.n[c] * float(step @ m.mean[c]) for c in pool) / size
                p, q = m.units / m.n[g], m.units / size
                f = Functional(treated - other, {g: p * step} | {c: -q * step for c in pool}, {g: p * treated} | {c: -q * other for c in pool})
                out.append((f, m.n[g]))
    if not plus:
        raise ValueError("nobody switches with controls at hand")
    return _weighted(plus), _weighted(minus)


def imputation(m: Moments) -> dict[int, tuple[float, int]]:
    """Mean gap to the outcome without treatment, by relative period.  The
    two-way effects of untreated cells depend on cohort means alone, so the
    normal equations have one row a period."""
    t = np.arange(1, m.periods + 1)
    a, b = np.zeros((m.periods, m.periods)), np.zeros(m.periods)
    for c, n in m.n.items():
        free = (t < c).astype(float)
        if free.sum():
            inside = np.diag(free) - np.outer(free, free) / free.sum()
            a += n * inside
            b += n * inside @ m.mean[c]
    time = np.linalg.pinv(a) @ b
    out: dict[int, list[tuple[float, int]]] = {}
    for c in m.cohorts:
        free = t < c
        if free.any():
            gap = m.mean[c] - time - (m.mean[c] - time)[free].mean()
            for k in range(c, m.periods + 1):
                out.setdefault(k - c, []).append((float(gap[k - 1]), m.n[c]))
    return {k: (sum(e * n for e, n in v) / sum(n for _, n in v), sum(n for _, n in v)) for k, v in sorted(out.items())}


def linear_functional(m: Moments, effect: Callable[[dict[int, np.ndarray]], float]) -> Functional:
    """The functional of an effect that is linear in the cohorts' means, read off
    by unit vectors; a unit's influence is its gap to its cohort's mean."""
    zero = {c: np.zeros(m.periods) for c in m.n}
    slope = {}
    for c in m.n:
        a = np.array([effect(zero | {c: e}) for e in np.eye(m.periods)])
        slope[c] = m.units / m.n[c] * a
    return Functional(effect(m.mean), slope, {c: float(slope[c] @ m.mean[c]) for c in m.n})


def imputation_effects(m: Moments) -> dict[int, Functional]:
    """``imputation`` with the influence of every unit, by relative period."""
    at = lambda k: lambda mean: imputation(replace(m, mean=mean))[k][0]
    return {k: linear_functional(m, at(k)) for k in imputation(m)}


def sun_abraham_regression(m: Moments, min_k: int | None = None, max_k: int | None = None, base: str = "never") -> tuple[dict[int, Functional], Functional]:
    """Interaction-weighted effects by the saturated regression itself: unit and
    period effects, and a dummy for each cohort and relative period but -1.
    Without never-treated units (``base='last'``) the last cohort takes their
    place, and its treated periods are left out.  Cells outside min_k..max_k have
    no dummy.  Units of a cohort share a row of the design, so cohort means,
    weighted by size, give the coefficients."""
    cohorts = m.cohorts
    control = NEVER if base == "never" else cohorts[-1]
    if control not in m.n:
        raise ValueError("no such base cohort")
    periods = m.periods if base == "never" else control - 1
    rows = [c for c in m.n if c == control or c in cohorts]
    cells = [(g, t) for g in cohorts if g != control for t in range(1, periods + 1) if t - g != -1 and (min_k is None or t - g >= min_k) and (max_k is None or t - g <= max_k)]
    design = np.zeros((len(rows) * periods, len(rows) + periods + len(cells)))
    weight = np.zeros(len(design))
    for i, c in enumerate(rows):
        for t in range(1, periods + 1):
            r = i * periods + t - 1
            design[r, i] = design[r, len(rows) + t - 1] = 1
            weight[r] = m.n[c]
            if (c, t) in cells:
                design[r, len(rows) + periods + cells.index((c, t))] = 1
    root = np.sqrt(weight)
    solve = np.linalg.pinv(design * root[:, None], rcond=1e-10) * root  # coefficients = solve @ stacked means
    part = solve[len(rows) + periods :].reshape(len(cells), len(rows), periods)
    by: dict[int, list[tuple[Functional, float]]] = {}
    for j, (g, t) in enumerate(cells):
        slope = {c: np.pad(part[j, i], (0, m.periods - periods)) for i, c in enumerate(rows)}
        f = Functional(float(sum(a @ m.mean[c] for c, a in slope.items())), {c: m.units / m.n[c] * a for c, a in slope.items()}, {c: m.units / m.n[c] * float(a @ m.mean[c]) for c, a in slope.items()})
        by.setdefault(t - g, []).append((f, m.n[g]))
    post = [x for k, parts in by.items() if k >= 0 for x in parts]
    return {k: _weighted(parts) for k, parts in sorted(by.items())}, _weighted(post)


def _treatment_residual(m: Moments) -> dict[int, np.ndarray]:
    t = np.arange(1, m.periods + 1)
    d = {c: (t >= c).astype(float) for c in m.n}
    mean_t = sum(m.n[c] * d[c] for c in d) / m.units
    return {c: d[c] - d[c].mean() - mean_t + mean_t.mean() for c in d}


def twfe(m: Moments, cluster: bool = True) -> dict[str, float]:
    """Two-way fixed effects with unit-clustered variance."""
    r = _treatment_residual(m)
    mean_t = sum(m.n[c] * m.mean[c] for c in m.n) / m.units
    ss = sum(m.n[c] * float(r[c] @ r[c]) for c in m.n)
    tau = sum(m.n[c] * float(r[c] @ m.mean[c]) for c in m.n) / ss
    f = Functional(tau, dict(r), {c: float(r[c] @ mean_t) + tau * float(r[c] @ r[c]) for c in r})
    v = influence_product(f, f, m) / ss**2 * (m.units / (m.units - 1) if cluster else 1.0)
    return {"effect": tau, "std_error": math.sqrt(v)}


def twfe_weights(m: Moments) -> dict[tuple[int, int], float]:
    """Weights that two-way fixed effects put on treated cells; some may be negative."""
    r = _treatment_residual(m)
    ss = sum(m.n[c] * float(r[c] @ r[c]) for c in m.n)
    return {(c, t): float(m.n[c] * r[c][t - 1] / ss) for c in m.cohorts for t in range(c, m.periods + 1)}


def two_by_two(m: Moments, treated: int, pre: list[int], post: list[int], control: int = NEVER) -> dict[str, float]:
    """Mean after less mean before, of a cohort against another; Welch test over units."""
    step = np.zeros(m.periods)
    step[[p - 1 for p in post]] += 1 / len(post)
    step[[p - 1 for p in pre]] -= 1 / len(pre)
    mean = {c: float(step @ m.mean[c]) for c in (treated, control)}
    var = {c: float(step @ m.spread[c] @ step) / (m.n[c] - 1) / m.n[c] for c in (treated, control)}
    total = var[treated] + var[control]
    df = total**2 / sum(var[c] ** 2 / (m.n[c] - 1) for c in (treated, control))
    return {"effect": mean[treated] - mean[control], "std_error": math.sqrt(total), "df": df}


def pretrend_test(m: Moments, control: str = "not_yet_treated") -> dict[str, float]:
    """Joint Wald test that all effects before treatment are 0."""
    leads = [f for k, f in event_study(group_time(m, control)).items() if k < 0]
    if not leads:
        raise ValueError("no period before treatment to test")
    n, k = m.units, len(leads)
    beta = np.array([f.effect for f in leads])
    v = np.array([[influence_product(a, b, m) for b in leads] for a in leads]) / n**2
    wald = float(beta @ np.linalg.pinv(v) @ beta)
    stat = wald / k * (n - k) / n
    return {"wald": wald, "f_statistic": stat, "df1": k, "df2": n - k, "p_value": f_sf(stat, k, n - k)}


def trend_breakdown(m: Moments, control: str = "not_yet_treated") -> dict[str, float]:
    """Slope of a linear violation of parallel trends that would undo the overall effect."""
    cells = group_time(m, control)
    post = [(k, sum(n for (g, t), (_, n, _) in cells.items() if t - g == k), f.effect) for k, f in event_study(cells).items() if k >= 0]
    total = sum(n for _, n, _ in post)
    effect = sum(n * e for _, n, e in post) / total
    reach = sum(n * (k + 1) for k, n, _ in post) / total
    pre = [(k, f.effect) for k, f in event_study(cells).items() if k < 0]
    steps = [abs(b - a) for (_, a), (_, b) in zip(pre, [*pre[1:], (-1, 0.0)], strict=True)]
    most = max(steps, default=math.nan)
    bends = [abs(b - a) for a, b in zip(steps, steps[1:], strict=False)]
    return {"effect": effect, "linear_breakdown": effect / reach, "relative_magnitude_breakdown": abs(effect) / (most * reach) if most else math.inf, "smoothness_observed": max(bends, default=0.0)}


def trend_sensitivity(m: Moments, multiples: tuple[float, ...] = (0.5, 1.0, 2.0), control: str = "not_yet_treated", alpha: float = 0.05) -> list[dict]:
    """Bounds of the overall effect when parallel trends may fail after treatment by
    ``multiple`` times the largest effect before it: as a level (``relative``), by
    that much more each period (``linear``), or with a slope that bends by that
    much each period (``smoothness``).  low and high hold the effect's own error
    too; ``breakdown`` is the failure a period that undoes the effect."""
    cells = group_time(m, control)
    study = event_study(cells)
    post = [(k, sum(n for (g, t), (_, n, _) in cells.items() if t - g == k)) for k in study if k >= 0]
    total = sum(n for _, n in post)
    growth = {"relative": 1.0, "linear": sum(n * (k + 1) for k, n in post) / total, "smoothness": sum(n * (k + 1) * (k + 2) / 2 for k, n in post) / total}
    largest = max((abs(f.effect) for k, f in study.items() if k < 0), default=0.0)
    all_ = overall(cells)
    got = estimate(all_, m)
    half = normal_ppf(1 - alpha / 2) * got["std_error"]
    rows = []
    for name, grow in growth.items():
        for multiple in multiples:
            wide = multiple * largest * grow + half
            rows.append({"restriction": name, "multiple": multiple, "effect": got["effect"], "bias": multiple * largest * grow, "low": got["effect"] - wide, "high": got["effect"] + wide, "breakdown": abs(got["effect"]) / grow, "robust": abs(got["effect"]) > wide})
    return rows
