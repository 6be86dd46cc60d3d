"""Identities, limits and small calibrations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veltrial.functions.special import t_two_sided
from veltrial.operators import clusters, guardrails, inference, looks, panel, quality, regression, sequential, simulate, synthetic, targeting
from veltrial.operators.heterogeneity import dml_effect, dr_learner, nuisances, r_learner, s_learner, t_learner, x_learner
from veltrial.plans import report
from veltrial.plans.warehouse import Warehouse
from veltrial.sources import traffic


def population(rng, n, rho=0.7):
    """Metric before and after, N(100, 30) and N(105, 30), correlated."""
    x = rng.normal(100, 30, n)
    return x, 105 + rho * (x - 100) + rng.normal(0, 30 * np.sqrt(1 - rho * rho), n)


def welch_p(a, b):
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    d = float(a.mean() - b.mean())
    return d, math.sqrt(va + vb), t_two_sided(d / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))


def arms(spark, n=400, lift=2.0, seed=0):
    rng = np.random.default_rng(seed)
    x, y = population(rng, n)
    t = np.arange(n) % 2
    pdf = pd.DataFrame({"experiment": "e", "variant": np.where(t == 1, "treatment", "control"), "x": x, "y": y + lift * t})
    return pdf, spark.createDataFrame(pdf)


def test_moments_drop_pairs_and_merge(spark):
    df = spark.createDataFrame([("e", "a", 1.0, 2.0, 0), ("e", "a", float("nan"), 1.0, 0), ("e", "a", 3.0, None, 1), ("e", "a", 4.0, 5.0, 1)], "experiment string, variant string, x double, y double, part int")
    whole = df.groupBy("experiment", "variant").agg(*inference.moments("y", "x"))
    parts = inference.merge(df.groupBy("experiment", "variant", "part").agg(*inference.moments("y", "x")), ["experiment", "variant"])
    assert whole.collect() == parts.collect()
    assert whole.first()["n"] == 2 and whole.first()["sum_xy"] == 22


def test_welch_and_cuped_identities(spark):
    pdf, df = arms(spark)
    pairs = inference.contrasts(df.groupBy("experiment", "variant").agg(*inference.moments("y", "x")))
    w = inference.power_columns(inference.with_test(inference.welch(pairs))).first()
    t, c = pdf[pdf.variant == "treatment"], pdf[pdf.variant == "control"]
    e, se, p = welch_p(t.y.to_numpy(), c.y.to_numpy())
    assert (w["effect"], w["std_error"], w["p_value"]) == pytest.approx((e, se, p))
    assert w["mde"] == pytest.approx(2.8015852 * se, rel=1e-6)
    q = inference.cuped(pairs).first()
    assert q["naive_effect"] - q["effect"] == pytest.approx(q["theta"] * q["pre_gap"])
    assert q["std_error"] < w["std_error"]
    own = inference.cuped(pairs, "control").first()
    assert own["theta"] == pytest.approx(np.cov(c.x, c.y)[0, 1] / c.x.var())


def test_degenerate_rows(spark):
    df = spark.createDataFrame([("e", v, y) for v in ("control", "treatment") for y in (1.0, 1.0)], "experiment string, variant string, y double")
    r = inference.with_test(inference.welch(inference.contrasts(df.groupBy("experiment", "variant").agg(*inference.moments("y"))))).first()
    assert r["p_value"] == 1 and r["ci_low"] == 0
    one = spark.createDataFrame([("e", "control", 1.0), ("e", "treatment", 2.0)], "experiment string, variant string, y double")
    assert inference.welch(inference.contrasts(one.groupBy("experiment", "variant").agg(*inference.moments("y")))).first()["std_error"] is None


def test_proportions(spark):
    df = spark.createDataFrame([("e", "control", 1000, 100.0), ("e", "treatment", 1000, 130.0)], "experiment string, variant string, n long, sum_y double")
    r = inference.two_proportions(inference.contrasts(df)).first()
    assert r["effect"] == pytest.approx(0.03) and r["z_statistic"] == pytest.approx(0.03 / math.sqrt(0.115 * 0.885 * 0.002))


def test_srm_states(spark):
    rows = [("ok", "a", 500, 0.5), ("ok", "b", 510, 0.5), ("bad", "a", 500, 0.5), ("bad", "b", 700, 0.5), ("small", "a", 3, 0.5), ("small", "b", 4, 0.5), ("none", "a", 0, 0.5), ("none", "b", 0, 0.5)]
    got = {r["experiment"]: r["status"] for r in inference.srm(spark.createDataFrame(rows, "experiment string, variant string, n long, design_weight double")).collect()}
    assert got == {"ok": "pass", "bad": "fail", "small": "warn", "none": "fail"}


def test_multivariate_theta_equals_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"experiment": "e", "a": x[:, 0], "b": x[:, 1], "v": y}))
    sums = inference.cross_sums(df, ["experiment"], {"a": F.col("a"), "b": F.col("b"), "y": F.col("v")})
    r = inference.multivariate_theta(sums, ["a", "b"]).first()
    want = np.linalg.lstsq(np.c_[x, np.ones(500)], y, rcond=None)[0][:2]
    assert r["theta"] == pytest.approx(want.tolist())
    assert r["extra_reduction"] > 0


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [("e", "treatment" if g % 2 else "control", f"c{g}", 100 + 5 * (g % 2) + b + rng.normal(0, 5)) for g in range(20) for b in [rng.normal(0, 4)] for _ in range(10 + g)]
    df = spark.createDataFrame(rows, "experiment string, variant string, cluster_id string, y double")
    totals = df.groupBy("experiment", "variant", "cluster_id").agg(*inference.moments("y"))
    assert clusters.mixed_clusters(totals).count() == 0
    r = clusters.cluster_robust(totals).first()
    pdf = pd.DataFrame(rows, columns=["e", "v", "g", "y"])
    t = (pdf.v == "treatment").to_numpy(float)
    x = np.c_[np.ones(len(t)), t]
    inv = np.linalg.inv(x.T @ x)
    u = pdf.y - x @ (inv @ x.T @ pdf.y)
    s = np.stack([(x[pdf.g == g] * u[pdf.g == g].to_numpy()[:, None]).sum(0) for g in pdf.g.unique()])
    v = inv @ s.T @ s @ inv * 20 / 19 * (len(t) - 1) / (len(t) - 2)
    assert r["std_error"] == pytest.approx(math.sqrt(v[1, 1]))
    assert 0 < clusters.icc(totals).first()["icc"] < 1
    b = clusters.wild_cluster_bootstrap(totals, n_bootstrap=199, seed=1).first()
    assert b["std_error"] == pytest.approx(r["std_error"]) and 0 < b["p_value"] <= 1
    assert clusters.wild_cluster_bootstrap(totals, n_bootstrap=199, imposed=False, weights="rademacher").first()["clusters"] == 20


def test_guardrails(spark):
    def result(experiment, guardrail, means):
        return [(experiment, guardrail, v, 10_000, 10_000 * m, 10_000 * (m * m + 0.01)) for v, m in means.items()]

    rows = result("e", "slow", {"control": 1.0, "treatment": 1.2}) + result("e", "near", {"control": 1.0, "treatment": 1.0505}) + result("e", "fine", {"control": 1.0, "treatment": 1.2})
    res = spark.createDataFrame(rows, "experiment string, guardrail string, variant string, user_cnt long, value_sum double, value_sq_sum double")
    config = spark.createDataFrame([("e", "slow", "lower_is_better", 0.05), ("e", "near", "lower_is_better", 0.05), ("e", "fine", "higher_is_better", 0.05), ("e", "absent", "lower_is_better", 0.05), ("f", "absent", "lower_is_better", 0.05)], "experiment string, guardrail string, direction string, max_harm double")
    out = guardrails.verdicts(guardrails.guardrail_harm(res, config))
    assert {r["guardrail"]: r["status"] for r in out.where("experiment = 'e'").collect()} == {"slow": "fail", "near": "warn", "fine": "pass", "absent": "unknown"}
    assert {r["experiment"]: r["verdict"] for r in guardrails.experiment_verdict(out).collect()} == {"e": "stop", "f": "unknown"}


def test_boundaries_spend_alpha():
    f = (0.2, 0.4, 0.6, 0.8, 1.0)
    for s in sequential.SPENDING:
        assert sum(sequential.exit_probabilities(f, sequential.boundaries(f, 0.05, s))) == pytest.approx(0.05, abs=1e-8)
    assert sequential.boundaries(f)[:2] == pytest.approx((4.3826, 3.0997), abs=2e-4)
    assert sequential.boundaries(f, 0.05, "pocock") == pytest.approx((2.4380, 2.4268, 2.4101, 2.3966, 2.3859), abs=2e-4)  # the published plan
    assert sequential.optimal_tau(1.0) == pytest.approx(2.87, abs=0.01)
    assert sequential.adjusted_p_value((1.0, 1.0, 2.5534), f) == pytest.approx(0.05, abs=2e-3)
    with pytest.raises(ValueError):
        sequential.boundaries((0.5, 0.4, 1.0))


def test_an_arm_is_judged_by_its_own_looks(spark):
    """A null arm beside one with an effect stays unrejected."""
    data = [("e", v, k + 1, (k + 1) / 5, e, 1.0 / math.sqrt(k + 1)) for v, e in (("strong", 3.0), ("null", 0.05)) for k in range(5)]
    rows = spark.createDataFrame(data, "experiment string, variant string, look int, info double, effect double, std_error double")
    last = {r["variant"]: r for r in sequential.always_valid_path(rows, 2.0).where("look = 5").collect()}
    assert last["strong"]["rejected"] and not last["null"]["rejected"] and last["null"]["always_valid_p"] > 0.5
    stops = {r["variant"]: r["stopped"] for r in sequential.monitor(rows, sequential.design(spark, (0.2, 0.4, 0.6, 0.8, 1.0))).where("look = 5").collect()}
    assert stops == {"strong": True, "null": False}


def test_three_arms_through_the_looks(spark):
    rng = np.random.default_rng(21)
    data = []
    for v, lift in (("control", 0.0), ("null", 0.0), ("strong", 25.0)):
        for d in range(1, 11):
            y = rng.normal(100 + lift, 30, 60)
            data.append(("e", v, f"2024-01-{d:02d}", 60, float(y.sum()), float((y * y).sum()), 0.0, 0.0, 0.0))
    daily = spark.createDataFrame(data, "experiment string, variant string, ds string, user_cnt long, post_sum double, post_sq_sum double, pre_sum double, pre_sq_sum double, pre_post_cross_sum double").withColumn("ds", F.to_date("ds"))
    effects = report.look_effects(daily, 5)
    last = {r["variant"]: r for r in sequential.always_valid_path(effects, 5.0).where("look = 5").collect()}
    assert set(last) == {"null", "strong"} and last["strong"]["rejected"] and not last["null"]["rejected"]
    assert looks.look_problems(looks.look_arms(daily, 5)).collect() == []
    late = daily.where("variant <> 'null' OR ds > '2024-01-05'")
    found = {r["problem"] for r in looks.look_problems(looks.look_arms(late, 5), spark.createDataFrame([("e", "control", 1)], "experiment string, variant string, n long")).collect()}
    assert found == {"an arm has fewer than two units", "an arm has fewer than two clusters"}


def test_design_helpers():
    f = (0.2, 0.4, 0.6, 0.8, 1.0)
    assert sequential.is_reliable(sequential.boundaries(f)) and not sequential.is_reliable((sequential.FAR,)) and not sequential.is_reliable(())
    tau = sequential.optimal_tau(2.0, 0.05)
    least = sequential.rejection_threshold(2.0, tau, 0.05)
    assert all(least <= sequential.rejection_threshold(2.0, tau * k, 0.05) for k in (0.9, 0.99, 1.01, 1.1))


def test_calibration_over_users(spark):
    rng = np.random.default_rng(5)
    x, y = population(rng, 600)
    rows = [(f"u{i}", "e", "any", f"c{i % 30}", f"2024-01-{1 + i % 10:02d}", float(a), float(b), 1 + i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    users = spark.createDataFrame(rows, "user_id string, experiment string, variant string, city string, expose_ds string, pre_metric double, post_metric double, post_cnt long").withColumn("expose_ds", F.to_date("expose_ds"))
    salts = spark.createDataFrame([(f"s{i}",) for i in range(80)], "salt string")
    got = {r["test"]: r for r in simulate.split_calibration(users, salts).collect()}
    assert set(got) == {"plain", "adjusted", "ratio"} and all(r["trials"] == 80 and r["low"] < 0.05 < r["high"] and 0.75 < r["sd_z"] < 1.25 for r in got.values())
    rules = {r["rule"]: r["rate"] for r in simulate.stopping_calibration(users, salts).collect()}
    assert rules["naive"] >= rules["sequential"] and rules["naive"] >= rules["fixed"] and rules["always_valid"] <= 0.05
    units = {r["unit"]: r["rate"] for r in simulate.cluster_calibration(users, salts).collect()}
    assert set(units) == {"user", "cluster"}
    path = simulate.convergence(simulate.rerandomise(users, salts).withColumn("hit", F.col("p_value") < 0.05), "hit", "salt").collect()
    assert len(path) == 80 and path[-1]["rate"] == got["plain"]["rate"]


def test_cross_fitted_theta_equals_row_by_row(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = x @ [1.0, -0.5] + rng.normal(size=300)
    f = np.arange(300) % 4
    df = spark.createDataFrame([("e", int(k), float(a), float(b), float(c)) for k, (a, b), c in zip(f, x, y, strict=True)], "experiment string, fold int, a double, b double, y double")
    got = inference.cross_fitted_theta(inference.cross_sums(df, ["experiment", "fold"], {c: F.col(c) for c in "aby"}), ["a", "b"]).first()
    z = np.empty(300)
    for k in range(4):
        other = f != k
        c = np.cov(np.c_[x[other], y[other]].T, ddof=0)
        z[f == k] = y[f == k] - (x[f == k] - x.mean(0)) @ np.linalg.solve(c[:2, :2], c[:2, 2])
    assert got["adjusted_variance"] == pytest.approx(z.var()) and got["variance_reduction"] == pytest.approx(1 - z.var() / y.var())


def test_weighted_quantile_equals_sorting(spark):
    rng = np.random.default_rng(7)
    v, w = rng.integers(0, 50, 400).astype(float), rng.random(400)
    df = spark.createDataFrame([(int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(zip(v, w, strict=True))], "k int, v double, w double")
    for level in (0.05, 0.5, 0.9, 1.0):
        got = {r["k"]: r["quantile"] for r in targeting.weighted_quantile(df, ["k"], "v", "w", level, chunks=8).collect()}
        for k in (0, 1):
            own = np.arange(400) % 2 == k
            order = np.argsort(v[own], kind="stable")
            share = np.cumsum(w[own][order]) / w[own].sum()
            assert got[k] == v[own][order][np.flatnonzero(share >= level - 1e-12)[0]]


def test_a_saturated_regression_gives_the_contrasts(spark):
    _, df = staggered(spark)
    m = panel.moments(df)
    want_k, want = panel.sun_abraham(m, "never_treated")
    got_k, got = panel.sun_abraham_regression(m)
    assert got.effect == pytest.approx(want.effect) and panel.std_error(got, m) == pytest.approx(panel.std_error(want, m))
    assert {k: f.effect for k, f in got_k.items()} == pytest.approx({k: f.effect for k, f in want_k.items()})
    last_k, _ = panel.sun_abraham_regression(m, base="last")
    assert last_k[0].effect == pytest.approx(2.0, abs=0.5)
    short, _ = panel.sun_abraham_regression(m, min_k=-2, max_k=3)
    assert set(short) == {-2, 0, 1, 2, 3}  # cells without a dummy serve as controls, so the effect shrinks
    assert 0 < short[0].effect < last_k[0].effect


def test_imputation_equals_two_way_regression(spark):
    pdf, df = staggered(spark, n=60)
    m = panel.moments(df)
    got = panel.imputation_effects(m)
    free = pdf["cohort"].isna() | (pdf["period"] < pdf["cohort"])
    units, periods = pd.get_dummies(pdf["unit"]).to_numpy(float), pd.get_dummies(pdf["period"]).to_numpy(float)
    design = np.c_[units, periods]
    beta = np.linalg.pinv(design[free.to_numpy()]) @ pdf["outcome"].to_numpy()[free.to_numpy()]
    gap = pdf["outcome"].to_numpy() - design @ beta
    k = (pdf["period"] - pdf["cohort"]).to_numpy()
    for lag, f in got.items():
        assert f.effect == pytest.approx(gap[k == lag].mean()) and panel.std_error(f, m) > 0


def test_traffic_helpers(spark):
    log = spark.createDataFrame([("e", "a", f"u{i}", f"2024-01-01 00:00:{i % 60:02d}") for i in range(2000)], "experiment string, variant string, user_id string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("ds", F.to_date("ts"))
    again = traffic.repeat_exposures(log, 0.1, 30)
    assert 2120 < again.count() < 2280
    late = again.groupBy("user_id").agg(F.count("*").alias("n"), (F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("gap")).where("n > 1")
    assert {r["gap"] for r in late.select("gap").distinct().collect()} == {1800}
    assert traffic.users_of_both(log, log.limit(3)).count() == 3
    ev = spark.createDataFrame([("u", "2024-01-02", 1.0), ("u", "2024-01-05", 3.0), ("v", "2024-01-03", 2.0)], "user_id string, ds string, x double").withColumn("ds", F.to_date("ds"))
    assert sorted(str(r["first_ds"]) for r in traffic.first_seen(ev).collect()) == ["2024-01-02", "2024-01-02", "2024-01-03"]
    assert {(r["x"], r["above"]) for r in traffic.split_by_median(ev.withColumn("g", F.lit(1)), "x", ["g"]).collect()} == {(1.0, False), (2.0, False), (3.0, True)}


def staggered(spark, n=240, t=8, effect=2.0, seed=0):
    rng = np.random.default_rng(seed)
    cohort = rng.choice([3, 5, 7, 0], n)
    rows = []
    for i in range(n):
        a = rng.normal()
        for p in range(1, t + 1):
            c = int(cohort[i])
            rows.append((i, p, c or None, float(a + 0.3 * p + (effect if c and p >= c else 0) + rng.normal(0, 0.5))))
    return pd.DataFrame(rows, columns=["unit", "period", "cohort", "outcome"]), spark.createDataFrame(rows, "unit long, period int, cohort int, outcome double")


def test_panel_estimators(spark):
    pdf, df = staggered(spark)
    m = panel.moments(df)
    cells = panel.group_time(m)
    assert panel.overall(cells).effect == pytest.approx(2.0, abs=0.15)
    # influence functions by units
    wide = pdf.pivot(index="unit", columns="period", values="outcome").to_numpy()
    cohort = pdf.drop_duplicates("unit")["cohort"].fillna(panel.NEVER).to_numpy()
    f, n1, n0 = cells[3, 5]
    dy, own, other = wide[:, 4] - wide[:, 1], cohort == 3, cohort > 5
    psi = np.where(own, (dy - dy[own].mean()) / own.mean(), 0) - np.where(other, (dy - dy[other].mean()) / other.mean(), 0)
    assert (n1, n0) == (own.sum(), other.sum())
    assert f.effect == pytest.approx(dy[own].mean() - dy[other].mean())
    assert panel.std_error(f, m) == pytest.approx(math.sqrt(psi.var(ddof=1) / len(psi)))
    plus, minus = panel.switchers(m)
    assert plus.effect == pytest.approx(panel.event_study(cells)[0].effect)  # the same instant comparison
    assert abs(minus.effect) < 0.3
    assert panel.sun_abraham(m)[1].effect == pytest.approx(2.0, abs=0.2)
    assert panel.imputation(m)[0][0] == pytest.approx(2.0, abs=0.2)
    assert panel.pretrend_test(m)["p_value"] > 0.001
    assert sum(panel.twfe_weights(m).values()) == pytest.approx(1.0)
    assert panel.trend_breakdown(m)["linear_breakdown"] > 0
    # two-way fixed effects by dummies
    d = (wide * 0).astype(float)
    for i, c in enumerate(cohort):
        d[i, int(min(c, 9)) - 1 :] = 1
    dd = d - d.mean(1, keepdims=True) - d.mean(0) + d.mean()
    yy = wide - wide.mean(1, keepdims=True) - wide.mean(0) + wide.mean()
    tau = (dd * yy).sum() / (dd**2).sum()
    s = (dd * (yy - tau * dd)).sum(1)
    got = panel.twfe(m)
    assert got["effect"] == pytest.approx(tau)
    assert got["std_error"] == pytest.approx(math.sqrt((s**2).sum() / (dd**2).sum() ** 2 * len(s) / (len(s) - 1)))
    with pytest.raises(ValueError):
        panel.moments(df.where("unit <> 3 OR period <> 2"))


def test_instruments_and_discontinuities(spark):
    rng = np.random.default_rng(3)
    n = 4000
    z, u = rng.integers(0, 2, n), rng.normal(size=n)
    d = 0.8 * z + u + rng.normal(size=n)
    y = 1.0 * d + 2 * u + rng.normal(size=n)
    x = rng.uniform(-1, 1, n)
    w = 0.5 * x + 1.5 * (x >= 0) + rng.normal(0, 0.3, n)
    take = (rng.random(n) < 0.2 + 0.6 * (x >= 0)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "d": d, "z": z.astype(float), "z2": rng.normal(size=n), "x": x, "w": w, "take": take, "v": 2 * take + rng.normal(size=n)}))
    iv = regression.two_sls(df, "y", "d", ["z", "z2"])
    assert abs(iv["effect"] - 1) < 4 * iv["std_error"] and iv["sargan_p"] > 1e-4
    assert regression.ols(df, "y", ["d"])["coef"][1] > 1.3
    assert not regression.first_stage_f(df, "d", ["z"])["weak"] and regression.first_stage_f(df, "d", ["z2"])["weak"]
    ar = regression.anderson_rubin(df, "y", "d", ["z"])
    assert ar["bounded"] and ar["low"] < 1 < ar["high"]
    h = regression.mse_bandwidth(df, "x", "w")
    for got in (regression.sharp_rdd(df, "x", "w", bandwidth=0.4), regression.robust_rdd(df, "x", "w", bandwidth=max(h, 0.3))):
        assert abs(got["effect"] - 1.5) < 4 * got["std_error"]
    assert len(regression.bandwidth_sensitivity(df, "x", "w", bandwidth=0.4)) == 3
    fuzzy = regression.fuzzy_rdd(df, "x", "v", "take", bandwidth=0.5)
    assert abs(fuzzy["effect"] - 2) < 4 * fuzzy["std_error"]
    with pytest.raises(ValueError):
        regression.fuzzy_rdd(df, "x", "v", "z2", bandwidth=0.5)
    assert regression.manipulation_test(df, "x", bandwidth=0.5)["p_value"] > 1e-3
    assert regression.boundary_constants("triangular") == pytest.approx((-0.1, 4.8), abs=1e-6)


def test_ranks_and_policies(spark):
    rng = np.random.default_rng(5)
    n = 500
    score = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 20, n).astype(float))  # a score that 40 % share
    pdf = pd.DataFrame({"id": np.arange(n), "score": score, "y": rng.normal(size=n), "d": rng.integers(0, 2, n).astype(float)})
    df = spark.createDataFrame(pdf)
    got = targeting.ranked(df, "score", "id", 16).orderBy("rank").toPandas()
    want = pdf.sort_values(["score", "id"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1, n + 1)) and got["id"].tolist() == want["id"].tolist()
    curve = targeting.qini_curve(df, y="y", treatment="d", score="score", id_column="id", points=n)
    yt, yc, nt, nc = (np.cumsum(v) for v in (want.y * want.d, want.y * (1 - want.d), want.d, 1 - want.d))
    full = yt - np.where(nc > 0, yc * nt / np.maximum(nc, 1), 0)
    assert curve.orderBy("fraction").toPandas()["qini"].to_numpy() == pytest.approx(full.to_numpy())
    a = targeting.auuc(curve).first()
    assert a["auuc"] == pytest.approx(np.trapezoid(full, np.arange(1, n + 1) / n))
    assert a["auuc_random"] == pytest.approx(np.trapezoid(np.linspace(0, full.iloc[-1], n), np.arange(1, n + 1) / n))
    assert targeting.rank_correlation(df, "score", "y").first()[0] == pytest.approx(pdf[["score", "y"]].corr("spearman").iloc[0, 1])
    g = df.withColumn("gamma", F.col("score") - 10)
    rules, value = targeting.learn_threshold_policy(g, ["score"], depth=1)
    assert rules[0][0] == "score" and rules[0][2] and value > 0
    assert targeting.split_policy_value(g, ["score"], "id", depth=1)["value"] > 0
    q = targeting.weighted_quantile(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "v double, w double"), [], "v", "w", 0.5).first()[0]
    assert q == 2.0
    c = targeting.conformal_intervals(df.withColumn("p", F.lit(0.5)).withColumn("m", F.lit(0.0)), y="y", d="d", mu1="m", mu0="m", propensity="p", calibrate=F.col("id") % 2 == 0)
    assert c.where("effect_low >= effect_high").count() == 0


def test_learners(spark):
    rng = np.random.default_rng(7)
    n = 1200
    x = rng.normal(size=(n, 2))
    d = (rng.random(n) < 0.5).astype(float)
    tau = 1 + (x[:, 0] > 0)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "d": d, "y": x[:, 1] + tau * d + rng.normal(0, 0.5, n), "tau": tau})).cache()
    s = nuisances(df, y="y", d="d", features=["a", "b"], id_column="id", n_folds=2).cache()
    e = dml_effect(s, "y", "d")
    assert abs(e["effect"] - 1.5) < 5 * e["std_error"] + 0.1
    for out in (s_learner(df, y="y", d="d", features=["a", "b"]), t_learner(df, y="y", d="d", features=["a", "b"]), x_learner(df, y="y", d="d", features=["a", "b"]), r_learner(s, y="y", d="d", features=["a", "b"]), dr_learner(s, y="y", d="d", features=["a", "b"])):
        assert out.agg(F.corr("cate", "tau")).first()[0] > 0.5


def test_synthetic_control(spark):
    rng = np.random.default_rng(11)
    factors = rng.normal(size=(12, 2))
    loads = np.vstack([[0.5, 0.5], [1, 0], [0, 1], *rng.normal(size=(5, 2))])
    y = factors @ loads.T + 10
    y[8:, 0] += 3
    df = spark.createDataFrame([(str(u), t + 1, float(y[t, u])) for t in range(12) for u in range(8)], "unit string, period int, outcome double")
    w = synthetic.synthetic_control(df, "0", 9).toPandas()
    assert w["weight"].sum() == pytest.approx(1) and w["effect"][0] == pytest.approx(3, abs=0.2)
    p = synthetic.placebo_inference(df, "0", 9).toPandas()
    assert len(p) == 8 and p["p_value"][0] == pytest.approx(1 / 8)
    assert len(synthetic.leave_one_out(df, "0", 9).collect()) == 7
    assert abs(synthetic.time_placebo(df, "0", 9, 5).first()["effect"]) < 0.5


def test_warehouse_round_trip_and_quality(spark, tmp_path):
    day = "2024-01-"
    exposure = [(f"{day}{5 + u % 3:02d} 10:00:00", f"u{u}", "e", "control" if u % 2 else "treatment") for u in range(40)] * 2
    events = [(f"{day}{d:02d}", f"u{u}", "buy" if d % 3 else "error", float(u + d)) for u in range(45) for d in range(1, 12)] + [(f"{day}02", "u1", "odd", 1.0)]
    raw = {
        "exposure_log": spark.createDataFrame(exposure, "ts string, user_id string, experiment string, variant string").withColumn("ts", F.to_timestamp("ts")).withColumn("note", F.lit("dropped")),
        "event_log": spark.createDataFrame(events, "ds string, user_id string, event_name string, metric_value double").withColumn("ds", F.to_date("ds")),
    }
    declared = [traffic.DeclaredExperiment("e", {"control": 0.5, "treatment": 0.5}, guardrails={"error": ("lower_is_better", 0.1)})]
    report = traffic.ingest(spark, raw, declared, str(tmp_path / "in"), metric_event="buy", guardrail_events=("error",))
    assert report.undeclared_events == {"odd": 1} and report.repeated_exposures == 40 and report.users_without_exposure == 5
    assert report.dropped_columns["exposure_log"] == ["note"]
    w = Warehouse(traffic.load_sources(spark, str(tmp_path / "in")), "buy", 7, 7)
    lazy = sorted(map(str, w.ads_experiment_result.collect()))
    stored = Warehouse(w.sources, "buy", 7, 7).write(str(tmp_path / "out"))
    assert sorted(str(r) for r in stored.ads_experiment_result.select(w.ads_experiment_result.columns).collect()) == lazy
    assert quality.check_quality(stored).where("bad > 0").count() == 0
    assert quality.cross_layer(stored).where("NOT ok").count() == 0
    assert {r["cluster_id"] for r in stored.dws_experiment_cluster_daily.collect()} == {"UNKNOWN"}
    assert quality.check_lineage(Warehouse.LINEAGE, Warehouse.TABLES, tuple(w.sources)) == []
    assert quality.check_lineage(Warehouse.LINEAGE, Warehouse.TABLES[::-1], tuple(w.sources))
    m = quality.manifest({"x": raw["event_log"]})
    assert quality.check_manifest(m, {"x": raw["event_log"]}).count() == 0
    assert quality.check_manifest(m, {"x": raw["event_log"].limit(3)}).count() == 1
    with pytest.raises(ValueError):
        traffic.ingest(spark, raw, [traffic.DeclaredExperiment("e", {"control": 0.5, "other": 0.5})], str(tmp_path / "no"), metric_event="buy")
    switch = raw["exposure_log"].union(raw["exposure_log"].where("user_id = 'u1'").withColumn("variant", F.lit("treatment")))
    assert quality.arm_switchers(traffic.conform(switch, "exposure_log")).count() == 1


def test_bad_rows_are_found(spark):
    from veltrial.schemas import TableContract

    df = spark.createDataFrame([("a", 1, -1.0, "up"), ("a", 1, 2.0, "sideways"), (None, 2, 3.0, None)], "k string, j int, v double, d string")
    got = {r["check"]: r["bad"] for r in quality.check_table(df, TableContract(("k", "j"), ("d",), {"d": ("up", "down")}, ("v",)), "t").collect()}
    assert got == {"null_key:k": 1, "null_key:j": 0, "null:d": 1, "enum:d": 2, "negative:v": 1, "duplicate_key": 1}


def test_csv_source(spark, tmp_path):
    (tmp_path / "e.csv").write_text("user_id,metric_value,ds,event_name,extra\nu1,2.5,2024-01-03,buy,x\n")
    got = traffic.conform(traffic.read_source(spark, str(tmp_path / "e.csv"), "event_log", "csv"), "event_log").first()
    assert got["metric_value"] == 2.5 and str(got["ds"]) == "2024-01-03"
    assert traffic.fingerprint({"b": 1, "a": 2}) == traffic.fingerprint({"a": 2, "b": 1})
