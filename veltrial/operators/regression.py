"""Least squares, instruments and discontinuities from cross-product sums.

Spark sums products of columns in one or two passes; the systems that remain
have as many rows as there are regressors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veltrial.functions.special import chi2_ppf, chi2_sf, f_sf, normal_ppf, normal_sf


def gram(frame: DataFrame, columns: dict[str, Column], weight: Column | None = None) -> tuple[int, np.ndarray]:
    """Number of rows and the matrix of summed (weighted) products."""
    names = list(columns)
    w = F.lit(1.0) if weight is None else weight
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = frame.agg(F.count("*").alias("n"), *[F.sum(w * columns[names[i]] * columns[names[j]]).alias(f"s{k}") for k, (i, j) in enumerate(at)]).first()
    m = np.zeros((len(names), len(names)))
    for k, (i, j) in enumerate(at):
        m[i, j] = m[j, i] = row[f"s{k}"] or 0.0
    return row["n"], m


def _line(coefficients: np.ndarray, columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for b, c in zip(coefficients, columns, strict=True):
        out = out + F.lit(float(b)) * c
    return out


def ols(frame: DataFrame, y: str, x: list[str]) -> dict:
    """Coefficients (constant first) with HC1 errors."""
    cols = {"1": F.lit(1.0)} | {c: F.col(c).cast("double") for c in x}
    n, m = gram(frame, cols | {"y": F.col(y).cast("double")})
    inv = np.linalg.pinv(m[:-1, :-1])
    b = inv @ m[:-1, -1]
    e = F.col(y) - _line(b, list(cols.values()))
    _, meat = gram(frame, cols, e * e)
    k = len(b)
    v = inv @ meat @ inv * n / max(n - k, 1)
    return {"coef": b, "std_error": np.sqrt(np.diag(v)), "cov": v, "n": n}


def first_stage_f(frame: DataFrame, d: str, z: list[str], x: list[str] | None = None) -> dict:
    """Robust Wald F of the excluded instruments."""
    fit = ols(frame, d, [*(x or []), *z])
    b, v = fit["coef"][-len(z) :], fit["cov"][-len(z) :, -len(z) :]
    stat = float(b @ np.linalg.pinv(v) @ b) / len(z)
    df = fit["n"] - len(fit["coef"])
    return {"f_statistic": stat, "p_value": f_sf(stat, len(z), df), "weak": stat < 10}


def two_sls(frame: DataFrame, y: str, d: str, z: list[str], x: list[str] | None = None) -> dict:
    """Two-stage least squares with robust errors; the effect of d is last."""
    x = x or []
    c = lambda name: F.col(name).cast("double")
    cols = {"1": F.lit(1.0)} | {n: c(n) for n in [*x, *z, d]} | {"__y": c(y)}
    names = list(cols)
    n, m = gram(frame, cols)
    inst = [names.index(a) for a in ["1", *x, *z]]
    reg = [names.index(a) for a in ["1", *x, d]]
    pick = lambda r, s: m[np.ix_(r, s)]
    first = np.linalg.pinv(pick(inst, inst)) @ pick(inst, reg)  # fitted regressors = instruments @ first
    a = np.linalg.pinv(first.T @ pick(inst, inst) @ first)
    b = a @ first.T @ pick(inst, [len(names) - 1])[:, 0]
    e = c(y) - _line(b, [cols[names[i]] for i in reg])
    _, meat = gram(frame, {names[i]: cols[names[i]] for i in inst}, e * e)
    v = a @ first.T @ meat @ first @ a * n / max(n - len(b), 1)
    # Sargan: n R^2 of the residual on the instruments
    yi = len(names) - 1
    ze = pick(inst, [yi])[:, 0] - pick(inst, reg) @ b
    ee = m[yi, yi] - 2 * b @ pick(reg, [yi])[:, 0] + b @ pick(reg, reg) @ b
    sargan = n * float(ze @ np.linalg.pinv(pick(inst, inst)) @ ze) / ee if ee > 0 else math.nan
    k = len(z) - 1
    return {"effect": float(b[-1]), "std_error": float(math.sqrt(v[-1, -1])), "coef": b, "n": n, "sargan": sargan if k else None, "sargan_p": chi2_sf(sargan, k) if k else None}


def anderson_rubin(frame: DataFrame, y: str, d: str, z: list[str], x: list[str] | None = None, alpha: float = 0.05, n_grid: int = 1201, span: float = 40.0) -> dict:
    """Interval that stays valid with weak instruments.  The score is linear and
    its variance quadratic in the tested effect, so three sums serve the grid."""
    x = x or []
    c = lambda name: F.col(name).cast("double")
    base = [F.lit(1.0), *[c(a) for a in x]]
    cols = {f"b{i}": b for i, b in enumerate(base)} | {n: c(n) for n in [*z, d]} | {"__y": c(y)}
    n, m = gram(frame, cols)
    k = len(base)
    proj = np.linalg.pinv(m[:k, :k]) @ m[:k, k:]
    resid = [v - _line(proj[:, j], base) for j, v in enumerate(list(cols.values())[k:])]
    zc, dc, yc = resid[: len(z)], resid[-2], resid[-1]
    aggs = []
    for i, a in enumerate(zc):
        aggs += [F.sum(a * yc).alias(f"zy{i}"), F.sum(a * dc).alias(f"zd{i}")]
        for j, b in enumerate(zc):
            aggs += [F.sum(a * b * yc * yc).alias(f"yy{i}_{j}"), F.sum(a * b * yc * dc).alias(f"yd{i}_{j}"), F.sum(a * b * dc * dc).alias(f"dd{i}_{j}")]
    r = frame.agg(*aggs).first()
    vec = lambda p: np.array([r[f"{p}{i}"] for i in range(len(z))])
    mat = lambda p: np.array([[r[f"{p}{i}_{j}"] for j in range(len(z))] for i in range(len(z))])
    zy, zd, yy, yd, dd = vec("zy"), vec("zd"), mat("yy"), mat("yd"), mat("dd")
    fit = two_sls(frame, y, d, z, x)
    grid = fit["effect"] + np.linspace(-span, span, n_grid) * fit["std_error"]
    limit = chi2_ppf(1 - alpha, len(z))
    keep = np.array([(s := zy - b * zd) @ np.linalg.pinv(yy - 2 * b * yd + b * b * dd) @ s <= limit for b in grid])
    if not keep.any():
        return {"low": None, "high": None, "bounded": True, "empty": True}
    at = np.flatnonzero(keep)
    return {"low": float(grid[at[0]]), "high": float(grid[at[-1]]), "bounded": not (keep[0] or keep[-1]), "empty": False}


# ---- discontinuities ---------------------------------------------------------

#: Boundary constants of the local linear fit: bias and variance.
KERNELS = ("uniform", "triangular", "epanechnikov")


def kernel_weight(u: Column, kernel: str) -> Column:
    inside = F.abs(u) <= 1
    value = {"uniform": F.lit(0.5), "triangular": 1 - F.abs(u), "epanechnikov": 0.75 * (1 - u * u)}[kernel]
    return F.when(inside, value).otherwise(0.0)


def boundary_constants(kernel: str) -> tuple[float, float]:
    u = (np.arange(200_000) + 0.5) / 200_000
    k = {"uniform": np.full_like(u, 0.5), "triangular": 1 - u, "epanechnikov": 0.75 * (1 - u * u)}[kernel]
    s = [float((k * u**j).mean()) for j in range(4)]
    det = s[0] * s[2] - s[1] ** 2
    return (s[2] ** 2 - s[1] * s[3]) / det, float((k * k * (s[2] - u * s[1]) ** 2).mean()) / det**2


def local_fit(frame: DataFrame, x: str, y: str, *, cutoff: float, bandwidth: float, kernel: str = "triangular", order: int = 1) -> dict[str, dict]:
    """Weighted polynomial on each side, with the HC0 sandwich: two passes for both sides."""
    u = (F.col(x).cast("double") - cutoff) / bandwidth
    rows = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.when(F.col(x) >= cutoff, "right").otherwise("left").alias("side"), u.alias("u"), F.col(y).cast("double").alias("y")).withColumn("w", kernel_weight(F.col("u"), kernel)).where("w > 0")
    power = lambda k: F.pow("u", F.lit(k)) if k else F.lit(1.0)
    p = order + 1
    sums = rows.groupBy("side").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), *[F.sum(F.col("w") * power(k)).alias(f"s{k}") for k in range(2 * p - 1)], *[F.sum(F.col("w") * F.col("y") * power(k)).alias(f"r{k}") for k in range(p)]).collect()
    out = {}
    for r in sums:
        inv = np.linalg.pinv(np.array([[r[f"s{i + j}"] for j in range(p)] for i in range(p)]))
        out[r["side"]] = {"n": r["n"], "inv": inv, "coef": inv @ np.array([r[f"r{k}"] for k in range(p)]), "weight": r["sw"]}
    if set(out) != {"left", "right"}:
        raise ValueError("no rows inside the bandwidth on one side")
    fitted = F.when(F.col("side") == "left", _line(out["left"]["coef"], [power(k) for k in range(p)])).otherwise(_line(out["right"]["coef"], [power(k) for k in range(p)]))
    e2 = F.col("w") * F.col("w") * (F.col("y") - fitted) * (F.col("y") - fitted)
    we2 = F.col("w") * (F.col("y") - fitted) * (F.col("y") - fitted)
    for r in rows.groupBy("side").agg(F.sum(we2).alias("ss"), *[F.sum(e2 * power(k)).alias(f"m{k}") for k in range(2 * p - 1)]).collect():
        side = out[r["side"]]
        side["cov"] = side["inv"] @ np.array([[r[f"m{i + j}"] for j in range(p)] for i in range(p)]) @ side["inv"]
        side["residual_ss"] = r["ss"]
    return out


def sharp_rdd(frame: DataFrame, x: str, y: str, *, cutoff: float = 0.0, bandwidth: float, kernel: str = "triangular", order: int = 1, alpha: float = 0.05) -> dict:
    fit = local_fit(frame, x, y, cutoff=cutoff, bandwidth=bandwidth, kernel=kernel, order=order)
    effect = float(fit["right"]["coef"][0] - fit["left"]["coef"][0])
    se = math.sqrt(fit["right"]["cov"][0, 0] + fit["left"]["cov"][0, 0])
    half = normal_ppf(1 - alpha / 2) * se
    return {"effect": effect, "std_error": se, "ci_low": effect - half, "ci_high": effect + half, "n_left": fit["left"]["n"], "n_right": fit["right"]["n"], "bandwidth": bandwidth}


def rule_bandwidth(frame: DataFrame, x: str, scale: float = 1.84) -> float:
    r = frame.agg(F.stddev_pop(x), F.count(x)).first()
    return scale * r[0] * r[1] ** -0.2


def mse_bandwidth(frame: DataFrame, x: str, y: str, *, cutoff: float = 0.0, kernel: str = "triangular") -> float:
    """Plug-in bandwidth from pilot curvature, variance and density on each side."""
    pilot = rule_bandwidth(frame, x)
    fit = local_fit(frame, x, y, cutoff=cutoff, bandwidth=pilot, kernel=kernel, order=2)
    sizes = {r["s"]: r["n"] for r in frame.groupBy(F.when(F.col(x) >= cutoff, "right").otherwise("left").alias("s")).agg(F.count("*").alias("n")).collect()}
    n, sd = sum(sizes.values()), pilot / 1.84 * sum(sizes.values()) ** 0.2
    bias, var = boundary_constants(kernel)
    bend = 2 * (fit["right"]["coef"][2] - fit["left"]["coef"][2]) / pilot**2
    if abs(bend) < 1e-12:
        return pilot
    noise = sum(fit[s]["residual_ss"] / max(fit[s]["weight"] - 3, 1) / max(fit[s]["weight"] / (sizes[s] * pilot), 1e-12) for s in ("left", "right"))
    return float(np.clip((noise * var / (bend * bias) ** 2 / n) ** 0.2, 0.05 * sd, 2 * sd))


def robust_rdd(frame: DataFrame, x: str, y: str, *, cutoff: float = 0.0, bandwidth: float, bias_bandwidth: float | None = None, kernel: str = "triangular", alpha: float = 0.05) -> dict:
    """Bias-corrected effect whose error counts the estimated bias: both are one
    linear functional of the outcomes, summed in a third pass."""
    h, b = bandwidth, bias_bandwidth or bandwidth
    scale = h * h / (b * b) * boundary_constants(kernel)[0]
    line = local_fit(frame, x, y, cutoff=cutoff, bandwidth=h, kernel=kernel, order=1)
    bend = local_fit(frame, x, y, cutoff=cutoff, bandwidth=b, kernel=kernel, order=2)

    uh, ub = (F.col(x).cast("double") - cutoff) / h, (F.col(x).cast("double") - cutoff) / b
    effect = bias = var = 0.0
    aggs = []
    for s, sign in (("right", 1.0), ("left", -1.0)):
        il, iq, cl, cq = line[s]["inv"][0], bend[s]["inv"][2], line[s]["coef"], bend[s]["coef"]
        w = kernel_weight(uh, kernel) * _line(il, [F.lit(1.0), uh]) - scale * kernel_weight(ub, kernel) * _line(iq, [F.lit(1.0), ub, ub * ub])
        near = kernel_weight(uh, kernel) > 0
        e = F.when(near, F.col(y) - _line(cl, [F.lit(1.0), uh])).when(kernel_weight(ub, kernel) > 0, F.col(y) - _line(cq, [F.lit(1.0), ub, ub * ub])).otherwise(0.0)
        side = F.col(x) >= cutoff if s == "right" else F.col(x) < cutoff
        aggs.append(F.sum(F.when(side, w * w * e * e)).alias(s))
        effect += sign * float(cl[0])
        bias += sign * scale * float(cq[2])

    r = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*aggs).first()
    var = (r["right"] or 0.0) + (r["left"] or 0.0)
    se, half = math.sqrt(var), normal_ppf(1 - alpha / 2) * math.sqrt(var)
    return {"effect": effect - bias, "std_error": se, "bias": bias, "ci_low": effect - bias - half, "ci_high": effect - bias + half, "bandwidth": h}


def fuzzy_rdd(frame: DataFrame, x: str, y: str, d: str, *, cutoff: float = 0.0, bandwidth: float, kernel: str = "triangular") -> dict:
    """Ratio of the jumps in y and in d; refuses a jump in d that is not significant."""
    fy = local_fit(frame, x, y, cutoff=cutoff, bandwidth=bandwidth, kernel=kernel)
    fd = local_fit(frame, x, d, cutoff=cutoff, bandwidth=bandwidth, kernel=kernel)
    jump = lambda f: float(f["right"]["coef"][0] - f["left"]["coef"][0])
    var = lambda f: f["right"]["cov"][0, 0] + f["left"]["cov"][0, 0]
    jy, jd = jump(fy), jump(fd)
    if abs(jd) < max(1e-8, 1.96 * math.sqrt(var(fd))):
        raise ValueError("the cutoff does not move treatment")
    u = (F.col(x).cast("double") - cutoff) / bandwidth
    w = kernel_weight(u, kernel)
    aggs = []
    for s in ("right", "left"):
        psi = w * _line(fy[s]["inv"][0], [F.lit(1.0), u])
        side = F.col(x) >= cutoff if s == "right" else F.col(x) < cutoff
        ey, ed = (F.col(c) - _line(f[s]["coef"], [F.lit(1.0), u]) for c, f in ((y, fy), (d, fd)))
        aggs.append(F.sum(F.when(side, psi * psi * ey * ed)).alias(s))
    r = frame.agg(*aggs).first()
    cov, tau = (r["right"] or 0.0) + (r["left"] or 0.0), jy / jd
    return {"effect": tau, "std_error": math.sqrt(max(var(fy) - 2 * tau * cov + tau * tau * var(fd), 0.0)) / abs(jd), "jump_y": jy, "jump_d": jd}


def bandwidth_sensitivity(frame: DataFrame, x: str, y: str, *, cutoff: float = 0.0, bandwidth: float, factors: tuple[float, ...] = (0.5, 1.0, 2.0), kernel: str = "triangular") -> list[dict]:
    return [{"factor": f} | sharp_rdd(frame, x, y, cutoff=cutoff, bandwidth=f * bandwidth, kernel=kernel) for f in factors]


def manipulation_test(frame: DataFrame, x: str, *, cutoff: float = 0.0, bandwidth: float | None = None, n_bins: int = 20) -> dict:
    """Jump of the log density: one histogram pass, then a Poisson-weighted line on each side."""
    h = bandwidth or rule_bandwidth(frame, x)
    place = F.floor((F.col(x).cast("double") - (cutoff - h)) / (2 * h / n_bins))
    got = {r["b"]: r["n"] for r in frame.where((F.col(x) >= cutoff - h) & (F.col(x) < cutoff + h)).groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}
    mid = (np.arange(n_bins) + 0.5) * 2 / n_bins - 1
    count = np.array([max(got.get(b, 0), 1) for b in range(n_bins)], float)
    ends = []
    for side in (mid < 0, mid >= 0):
        m = np.c_[np.ones(side.sum()), mid[side]]
        inv = np.linalg.pinv(m.T @ (m * count[side, None]))
        ends.append((float((inv @ (m.T @ (count[side] * np.log(count[side]))))[0]), float(inv[0, 0])))
    jump, se = ends[1][0] - ends[0][0], math.sqrt(ends[0][1] + ends[1][1])
    return {"log_jump": jump, "std_error": se, "z": jump / se, "p_value": 2 * normal_sf(abs(jump / se)), "bandwidth": h}
