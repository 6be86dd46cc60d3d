"""Queries over the driver's tables, one per operator, each lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veltrial.operators import clusters, guardrails, inference, looks, panel, quality, regression, sequential, targeting
from veltrial.plans import report
from veltrial.plans.warehouse import ARM, Warehouse
from veltrial.sources import events, traffic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_KEPT: dict[tuple[str, str, str], Warehouse] = {}


def _listing(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files under a path: other files, another warehouse."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return traffic.fingerprint(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of a directory.  Its users and daily sums are kept by the
    session, so that the join of exposures and events runs once for all queries."""
    key = (spark.sparkContext.applicationId, sf_dir, _listing(spark, f"{sf_dir}/events.parquet"))
    if key not in _KEPT:
        for (app, *_), old in _KEPT.items():
            if app == key[0]:
                old.release()
        _KEPT.clear()
        _KEPT[key] = Warehouse(events.sources(spark, sf_dir), events.METRIC_EVENT, events.WINDOW_DAYS, events.WINDOW_DAYS).keep()
    return _KEPT[key]


def rounded(frame: DataFrame, **digits: int) -> DataFrame:
    """Doubles to 4 places, or as said: engines add in different orders."""
    kinds = dict(frame.dtypes)
    return frame.select(*[F.round(c, digits.get(c, 4)).alias(c) if kinds[c] == "double" else F.col(c) for c in frame.columns])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sources and layers --------------------------------------------------------


@query
def ods_event_log(spark, sf_dir):
    return rounded(events.sources(spark, sf_dir)["event_log"])


@query
def ods_exposure_log(spark, sf_dir):
    return events.sources(spark, sf_dir)["exposure_log"]


@query
def ods_user_profile(spark, sf_dir):
    return events.sources(spark, sf_dir)["user_profile"]


@query
def dim_experiment_config(spark, sf_dir):
    return events.sources(spark, sf_dir)["experiment_config"].select("experiment", "variant", "design_weight", "layer")


@query
def dim_guardrail_config(spark, sf_dir):
    return events.sources(spark, sf_dir)["guardrail_config"]


def _layer(name: str, drop: tuple[str, ...] = (), **digits: int) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(getattr(warehouse(spark, sf_dir), name).drop(*drop), **digits)


_layer("dwd_experiment_user")
_layer("dws_experiment_variant_daily")
_layer("ads_experiment_result", ("hypothesis", "true_lift"))
_layer("ads_experiment_srm", relative_deviation=6, chi2_component=6, chi2_statistic=6)
_layer("dws_experiment_cluster_daily")
_layer("dws_experiment_ratio_daily")
_layer("ads_experiment_ratio_result")
_layer("dws_experiment_guardrail_daily")
_layer("ads_experiment_guardrail_result")
_layer("dws_experiment_covariate_daily")
_layer("ads_experiment_covariate_result")


# ---- inference -----------------------------------------------------------------


def _pairs(spark, sf_dir) -> DataFrame:
    return inference.contrasts(inference.from_result(warehouse(spark, sf_dir).ads_experiment_result))


_TEST = ["experiment", "variant", "effect", "std_error", "df"]


@query
def welch_effect(spark, sf_dir):
    return rounded(inference.welch(_pairs(spark, sf_dir)).select(*_TEST, "relative_effect"), relative_effect=6)


@query
def welch_test(spark, sf_dir):
    return rounded(inference.power_columns(inference.with_test(inference.welch(_pairs(spark, sf_dir)))), p_value=8)


@query
def cuped_effect(spark, sf_dir):
    return rounded(inference.cuped(_pairs(spark, sf_dir)).select(*_TEST, "theta", "correlation", "pre_gap_z"), theta=6, correlation=6, pre_gap_z=6)


@query
def cuped_test(spark, sf_dir):
    return rounded(inference.balance(inference.with_test(inference.cuped(_pairs(spark, sf_dir)))), p_value=8)


_COVARIATES = {"pre_metric": F.col, "pre_cnt": lambda c: F.col(c).cast("double")}


def _cross_columns() -> dict:
    return {c: make(c) for c, make in _COVARIATES.items()} | {"y": F.col("post_metric")}


@query
def multivariate_cuped(spark, sf_dir):
    users = warehouse(spark, sf_dir).dwd_experiment_user
    got = inference.multivariate_theta(inference.cross_sums(users, ["experiment"], _cross_columns()), list(_COVARIATES))
    thetas = [F.col("theta")[i].alias(f"theta_{c}") for i, c in enumerate(_COVARIATES)]
    return rounded(got.select("experiment", *thetas, *got.columns[2:]), theta_pre_metric=6, variance_reduction=6, best_single_reduction=6, extra_reduction=6)


@query
def cross_fitted_cuped(spark, sf_dir):
    """Five folds by the user's number."""
    users = warehouse(spark, sf_dir).dwd_experiment_user.withColumn("fold", F.col("user_id").cast("long") % 5)
    sums = inference.cross_sums(users, ["experiment", "fold"], _cross_columns())
    return rounded(inference.cross_fitted_theta(sums, list(_COVARIATES)), variance_reduction=6)


@query
def two_proportions(spark, sf_dir):
    """Share of users with a purchase after exposure."""
    users = warehouse(spark, sf_dir).dwd_experiment_user
    arms = users.groupBy(*ARM).agg(*inference.moments(F.when(F.col("post_cnt") > 0, 1.0).otherwise(0.0)))
    names = ("effect", "std_error", "ci_low", "ci_high", "z_statistic", "p_value")
    return rounded(inference.two_proportions(inference.contrasts(arms)), **dict.fromkeys(names, 6))


@query
def unit_ratio_gap(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    delta = inference.ratio_delta(inference.contrasts(w.ads_experiment_ratio_result.withColumnRenamed("user_cnt", "n")))
    return rounded(inference.ratio_gap(inference.unit_ratio(w.dwd_experiment_user, "post_metric", "post_cnt"), delta), relative_gap=6)


@query
def sample_ratio_info(spark, sf_dir):
    counts = warehouse(spark, sf_dir).ads_experiment_result.select(*ARM, F.col("user_cnt").alias("n"))
    return rounded(inference.srm_from_weights(counts), share=6)


@query
def ratio_delta_effect(spark, sf_dir):
    r = warehouse(spark, sf_dir).ads_experiment_ratio_result.withColumnRenamed("user_cnt", "n")
    return rounded(inference.ratio_delta(inference.contrasts(r)).select(*_TEST))


@query
def unit_ratio(spark, sf_dir):
    return rounded(inference.unit_ratio(warehouse(spark, sf_dir).dwd_experiment_user, "post_metric", "post_cnt"))


@query
def sample_ratio_test(spark, sf_dir):
    a = warehouse(spark, sf_dir).ads_experiment_result.select("experiment", "variant", F.col("user_cnt").alias("n"), "design_weight")
    return rounded(inference.srm(a), p_value=8)


def _clusters(spark, sf_dir) -> DataFrame:
    return clusters.cluster_totals(warehouse(spark, sf_dir).dws_experiment_cluster_daily)


@query
def cluster_level_effect(spark, sf_dir):
    return rounded(clusters.cluster_level(_clusters(spark, sf_dir)).select(*_TEST))


@query
def cluster_robust_effect(spark, sf_dir):
    return rounded(clusters.cluster_robust(_clusters(spark, sf_dir)))


@query
def icc_components(spark, sf_dir):
    return rounded(clusters.icc(_clusters(spark, sf_dir)).select("experiment", "clusters", "units", "ms_between", "ms_within", "m0"), m0=6)


@query
def cluster_cuped_effect(spark, sf_dir):
    return rounded(clusters.cluster_cuped(_clusters(spark, sf_dir)).select(*_TEST, "theta"), theta=6)


@query
def cluster_pass_through(spark, sf_dir):
    return clusters.pass_through(warehouse(spark, sf_dir).dwd_experiment_user, "exp_")


@query
def mixed_clusters(spark, sf_dir):
    return clusters.mixed_clusters(_clusters(spark, sf_dir))


@query
def wild_bootstrap(spark, sf_dir):
    """Of the experiments whose clusters each hold one arm: the others aren't randomised by cluster."""
    totals = _clusters(spark, sf_dir)
    mixed = clusters.mixed_clusters(totals).select("experiment").distinct()
    return rounded(clusters.wild_cluster_bootstrap(totals.join(mixed, "experiment", "left_anti"), n_bootstrap=999, seed=7))


def _harm(spark, sf_dir) -> DataFrame:
    w = warehouse(spark, sf_dir)
    return guardrails.guardrail_harm(w.ads_experiment_guardrail_result, w.sources["guardrail_config"])


@query
def guardrail_harm(spark, sf_dir):
    return rounded(_harm(spark, sf_dir).drop("df"), harm=6, std_error=6, max_harm=6)


@query
def guardrail_verdicts(spark, sf_dir):
    return rounded(guardrails.verdicts(_harm(spark, sf_dir)))


# ---- looks and sequential rules -------------------------------------------------


@query
def cumulative_looks(spark, sf_dir):
    return rounded(looks.cumulative(warehouse(spark, sf_dir).dws_experiment_variant_daily))


def _look_effects(spark, sf_dir, estimator: str = "post_only") -> DataFrame:
    return report.look_effects(warehouse(spark, sf_dir).dws_experiment_variant_daily, 5, estimator=estimator)


@query
def cuped_looks(spark, sf_dir):
    """Adjusted effect at each look, theta estimated anew."""
    return rounded(_look_effects(spark, sf_dir, "cuped"), info=6)


@query
def ratio_looks(spark, sf_dir):
    return rounded(report.look_effects(warehouse(spark, sf_dir).dws_experiment_ratio_daily, 5, estimator="ratio_delta"), info=6)


@query
def cluster_effects_by_look(spark, sf_dir):
    """Cluster means, adjusted cluster means and users as units, at the same looks."""
    daily = warehouse(spark, sf_dir).dws_experiment_cluster_daily
    parts = [report.look_effects(daily, 3, estimator=e).withColumn("estimator", F.lit(e)) for e in ("cluster_level", "cluster_cuped", "unit_level")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), info=6)


@query
def monitoring(spark, sf_dir):
    """exp_a as declared by user and adjusted mean, exp_city by cluster and adjusted mean."""
    got = report.monitoring(warehouse(spark, sf_dir), {"exp_a": ("unit", "mean", "cuped"), "exp_city": ("cluster", "mean", "cuped")}, n_looks=3)
    return rounded(got, info=6, effect=3, std_error=3, beside_effect=3, beside_std_error=3, z=3, repeated_low=2, repeated_high=2, always_valid_p=5, tau=3)


@query
def look_problems(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    counts = clusters.cluster_counts(_clusters(spark, sf_dir))
    return looks.look_problems(looks.look_arms(w.dws_experiment_variant_daily, 5), counts)


@query
def late_arm_problems(spark, sf_dir):
    """What is found where the treatment of the warehouse's experiments starts on the 20th only."""
    daily = warehouse(spark, sf_dir).dws_experiment_variant_daily.where((F.col("variant") == "control") | (F.dayofmonth("ds") >= 20))
    return looks.look_problems(looks.look_arms(daily, 5))


@query
def look_picks(spark, sf_dir):
    run = looks.cumulative(warehouse(spark, sf_dir).dws_experiment_variant_daily)
    return rounded(looks.pick_looks(looks.information(run), 5), info=6)


@query
def msprt_path(spark, sf_dir):
    path = sequential.always_valid_path(_look_effects(spark, sf_dir), tau=20.0)
    return rounded(path.select("experiment", "variant", "look", "effect", "std_error", "p", "always_valid_p"), p=6, always_valid_p=6)


@query
def sequential_monitor(spark, sf_dir):
    """Each arm against the bounds at its looks' own information."""
    return rounded(sequential.monitor(_look_effects(spark, sf_dir)), info=6, z=3, repeated_low=2, repeated_high=2, spent=6)


@query
def sequential_design(spark, sf_dir):
    plans = [sequential.design(spark, (0.2, 0.4, 0.6, 0.8, 1.0), spending=s).withColumn("spending", F.lit(s)) for s in sequential.SPENDING]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query
def posterior_mean_sd(spark, sf_dir):
    rows = inference.welch(_pairs(spark, sf_dir)).select("experiment", "variant", "effect", "std_error")
    return rounded(sequential.posterior(rows, 0.0, 50.0).select("experiment", "variant", "posterior_mean", "posterior_sd"))


@query
def bayesian_decision(spark, sf_dir):
    rows = inference.welch(_pairs(spark, sf_dir)).select("experiment", "variant", "effect", "std_error")
    return rounded(sequential.decide(sequential.posterior(rows, 0.0, 50.0), loss_threshold=0.5))


@query
def cluster_looks(spark, sf_dir):
    return rounded(looks.cluster_looks(warehouse(spark, sf_dir).dws_experiment_cluster_daily, 3), info=6)


@query
def experiment_report(spark, sf_dir):
    return rounded(report.experiment_report(warehouse(spark, sf_dir)), p_value=8)


# ---- traffic and quality ---------------------------------------------------------


@query
def salt_agreement(spark, sf_dir):
    """Users that two experiments share, and how often their arms agree."""
    arms = events.sources(spark, sf_dir)["exposure_log"].select("experiment", "variant", "user_id").distinct()
    both = arms.alias("a").join(arms.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.experiment") < F.col("b.experiment")))
    same = F.avg(F.when(F.col("a.variant") == F.col("b.variant"), 1.0).otherwise(0.0))
    return both.groupBy(F.col("a.experiment").alias("left_experiment"), F.col("b.experiment").alias("right_experiment")).agg(F.count("*").alias("shared_users"), F.round(same, 6).alias("agreement"))


@query
def arm_shares(spark, sf_dir):
    share = F.col("user_cnt") / F.sum("user_cnt").over(Window.partitionBy("experiment"))
    return warehouse(spark, sf_dir).ads_experiment_result.select(*ARM, "user_cnt", F.round(share, 6).alias("share"))


@query
def repeated_exposures(spark, sf_dir):
    return traffic.repeated_exposures(events.sources(spark, sf_dir)["exposure_log"])


@query
def undeclared_events(spark, sf_dir):
    return traffic.undeclared_events(events.sources(spark, sf_dir)["event_log"], ["purchase", "error"])


@query
def users_without_exposure(spark, sf_dir):
    s = events.sources(spark, sf_dir)
    return traffic.users_without_exposure(s["event_log"], s["exposure_log"].where(F.col("experiment") == "exp_city"))


@query
def users_of_both_halves(spark, sf_dir):
    """Events of the first half of the month by users that the second half knows too."""
    log = events.sources(spark, sf_dir)["event_log"]
    half = F.dayofmonth("ds") <= 15
    return rounded(traffic.users_of_both(log.where(half), log.where(~half)).groupBy("event_name").agg(F.count("*").alias("rows"), F.sum("metric_value").alias("value")))


@query
def days_since_first_seen(spark, sf_dir):
    seen = traffic.first_seen(events.sources(spark, sf_dir)["event_log"])
    return seen.groupBy(F.datediff("ds", "first_ds").alias("day")).agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"))


@query
def median_split(spark, sf_dir):
    """Users above the median of their arm before exposure."""
    split = traffic.split_by_median(warehouse(spark, sf_dir).dwd_experiment_user, "pre_metric", ARM)
    return rounded(split.groupBy(*ARM).agg(F.max("median").alias("median"), F.count_if("above").alias("above"), F.count("*").alias("users")))


@query
def live_shares(spark, sf_dir):
    return rounded(traffic.live_shares(warehouse(spark, sf_dir).dwd_experiment_user), live_share=6)


@query
def declared_lifts(spark, sf_dir):
    return traffic.declared_lifts(events.sources(spark, sf_dir)["experiment_config"])


@query
def list_experiments(spark, sf_dir):
    s = events.sources(spark, sf_dir)
    return traffic.list_experiments(s["exposure_log"], s["experiment_config"], s["guardrail_config"])


@query
def retried_exposures(spark, sf_dir):
    """First exposures are the same with a tenth of the log sent again later."""
    from veltrial.plans.warehouse import first_exposures

    log = events.sources(spark, sf_dir)["exposure_log"]
    again = traffic.repeat_exposures(log, 0.1, 30)
    return first_exposures(again).groupBy(*ARM).agg(F.count("*").alias("users"), F.min("expose_ts").alias("first_ts"), F.max("expose_ts").alias("last_ts"))


@query
def switched_arms(spark, sf_dir):
    """Users that a deliberately broken split shows both arms of an experiment."""
    s = events.sources(spark, sf_dir)["event_log"]
    broken = s.select(F.lit("broken").alias("experiment"), F.when(F.dayofmonth("ds") % 2 == 0, "control").otherwise("treatment").alias("variant"), "user_id")
    return quality.arm_switchers(broken)


@query
def arm_switchers(spark, sf_dir):
    return quality.arm_switchers(warehouse(spark, sf_dir).dwd_experiment_user)


@query
def cross_layer(spark, sf_dir):
    return rounded(quality.cross_layer(warehouse(spark, sf_dir)))


@query
def quality_checks(spark, sf_dir):
    return quality.check_quality(warehouse(spark, sf_dir))


@query
def metric_shape(spark, sf_dir):
    """Moments of the metric; skewness and excess kurtosis without bias."""
    y, n = F.col("post_metric"), F.count("*")
    skew = F.skewness(y) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis(y) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return (
        warehouse(spark, sf_dir)
        .dwd_experiment_user.groupBy("experiment")
        .agg(n.alias("n"), F.round(F.avg(y), 4).alias("mean"), F.round(F.stddev_samp(y), 4).alias("sd"), F.round(F.max(y), 4).alias("largest"), F.round(F.avg(F.when(y == 0, 1.0).otherwise(0.0)), 6).alias("zero_share"), F.round(skew, 6).alias("skewness"), F.round(kurt, 6).alias("kurtosis"))
    )


@query
def quarter_rollup(spark, sf_dir):
    q = F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")
    return read(spark, sf_dir, "orders").groupBy(q).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("revenue"))


# ---- assignment -------------------------------------------------------------------


@query
def assignment_shares(spark, sf_dir):
    from veltrial.operators.assignment import Arm, Experiment, assign, distribution

    units = read(spark, sf_dir, "customer").select(F.format_string("u%07d", "c_custkey").alias("user_id"))
    exp = Experiment("checkout", (Arm("control", 0.5), Arm("treatment", 0.5)), traffic_ratio=0.8)
    return distribution(assign(units, exp), exp)


@query
def assignment_codes(spark, sf_dir):
    """Integer codes of three arms, -1 for those not enrolled."""
    from veltrial.operators.assignment import Arm, Experiment, assign

    units = read(spark, sf_dir, "customer").select(F.format_string("u%07d", "c_custkey").alias("user_id"))
    exp = Experiment("search", (Arm("control", 0.5), Arm("short", 0.3), Arm("long", 0.2)), traffic_ratio=0.9)
    return assign(units, exp).groupBy("arm_code").agg(F.count("*").alias("units"))


@query
def layer_routing(spark, sf_dir):
    from veltrial.operators.assignment import Layer, Slot, route

    units = read(spark, sf_dir, "customer").select(F.format_string("u%07d", "c_custkey").alias("user_id"))
    layer = Layer("ranking", (Slot("a", 0, 4000), Slot("b", 4000, 7000)))
    return route(units, layer).groupBy("experiment").agg(F.count("*").alias("units"))


# ---- panels, regressions, targeting -------------------------------------------------


def order_panel(spark, sf_dir) -> DataFrame:
    """Revenue of each customer in each of seven years; cohorts by the customer's key."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") - 1994).alias("period"), F.col("o_totalprice").cast("double").alias("v"))
    k = F.col("o_custkey") % 4
    units = orders.select(F.col("o_custkey").alias("unit")).distinct().withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(7))))
    sums = orders.groupBy(F.col("o_custkey").alias("unit"), "period").agg(F.sum("v").alias("v"))
    k = F.col("unit") % 4
    return units.join(sums, ["unit", "period"], "left").select("unit", "period", F.when(k == 1, 4).when(k == 2, 5).when(k == 3, 6).alias("cohort"), F.coalesce("v", F.lit(0.0)).alias("outcome"))


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@query
def did_two_by_two(spark, sf_dir):
    got = panel.two_by_two(panel.moments(order_panel(spark, sf_dir)), 4, [1, 2, 3], [4, 5, 6, 7])
    return rounded(_rows(spark, [got], "effect double, std_error double"))


@query
def did_twfe(spark, sf_dir):
    return rounded(_rows(spark, [panel.twfe(panel.moments(order_panel(spark, sf_dir)))], "effect double, std_error double"))


@query
def did_group_time(spark, sf_dir):
    cells = panel.group_time(panel.moments(order_panel(spark, sf_dir)))
    rows = [{"cohort": g, "period": t, "effect": f.effect, "treated": n, "controls": c} for (g, t), (f, n, c) in cells.items()]
    return rounded(_rows(spark, rows, "cohort long, period long, effect double, treated long, controls long"))


@query
def did_event_study(spark, sf_dir):
    """Effects by period since treatment under three estimators."""
    m = panel.moments(order_panel(spark, sf_dir))
    cells = panel.group_time(m)
    named = [("group_time", k, f) for k, f in panel.event_study(cells).items()] + [("group_time_overall", None, panel.overall(cells))]
    by_k, total = panel.sun_abraham(m)
    named += [("interaction_weighted", k, f) for k, f in by_k.items()] + [("interaction_weighted_overall", None, total)]
    plus, minus = panel.switchers(m)
    named += [("switchers", 0, plus), ("switchers_placebo", -1, minus)]
    rows = [{"estimator": e, "k": "all" if k is None else str(k)} | panel.estimate(f, m) for e, k, f in named]
    return rounded(_rows(spark, rows, "estimator string, k string, effect double, std_error double, p_value double, ci_low double, ci_high double"), p_value=8)


@query
def did_imputation(spark, sf_dir):
    """Gaps to the imputed outcome without treatment, with the influence of every unit."""
    m = panel.moments(order_panel(spark, sf_dir))
    rows = [{"k": k} | panel.estimate(f, m) for k, f in panel.imputation_effects(m).items()]
    return rounded(_rows(spark, rows, "k int, effect double, std_error double, p_value double, ci_low double, ci_high double"))


@query
def did_saturated_regression(spark, sf_dir):
    m = panel.moments(order_panel(spark, sf_dir))
    by_k, total = panel.sun_abraham_regression(m)
    rows = [{"k": str(k)} | panel.estimate(f, m) for k, f in [*by_k.items(), ("all", total)]]
    return rounded(_rows(spark, rows, "k string, effect double, std_error double, p_value double, ci_low double, ci_high double"), p_value=8)


@query
def did_trend_breakdown(spark, sf_dir):
    b = panel.trend_breakdown(panel.moments(order_panel(spark, sf_dir)))
    return rounded(_rows(spark, [b], "effect double, linear_breakdown double, relative_magnitude_breakdown double, smoothness_observed double"), relative_magnitude_breakdown=6)


@query
def did_trend_sensitivity(spark, sf_dir):
    """Bounds of the overall effect under three ways in which trends may part."""
    rows = panel.trend_sensitivity(panel.moments(order_panel(spark, sf_dir)))
    return rounded(_rows(spark, rows, "restriction string, multiple double, effect double, bias double, low double, high double, breakdown double, robust boolean"), bias=2, low=2, high=2)


@query
def did_pretrend(spark, sf_dir):
    m = panel.moments(order_panel(spark, sf_dir))
    return rounded(_rows(spark, [panel.pretrend_test(m) | panel.trend_breakdown(m)], "wald double, f_statistic double, df1 int, df2 int, p_value double, linear_breakdown double, relative_magnitude_breakdown double"))


@query
def did_twfe_weights(spark, sf_dir):
    w = panel.twfe_weights(panel.moments(order_panel(spark, sf_dir)))
    return rounded(_rows(spark, [{"cohort": c, "period": t, "weight": x} for (c, t), x in w.items()], "cohort long, period int, weight double"), weight=6)


def _lines(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x"), F.when(F.col("l_partkey") % 2 == 0, 1.0).otherwise(0.0).alias("z"), (F.col("l_partkey") % 5).cast("double").alias("z2"))


@query
def iv_wald(spark, sf_dir):
    return rounded(_rows(spark, [regression.two_sls(_lines(spark, sf_dir), "y", "x", ["z"])], "effect double, n long"))


@query
def iv_interval(spark, sf_dir):
    got = regression.anderson_rubin(_lines(spark, sf_dir), "y", "x", ["z", "z2"]) | regression.first_stage_f(_lines(spark, sf_dir), "x", ["z", "z2"])
    return rounded(_rows(spark, [got], "low double, high double, bounded boolean, empty boolean, f_statistic double, weak boolean"))


@query
def ols_line(spark, sf_dir):
    b = regression.ols(_lines(spark, sf_dir), "y", ["x"])["coef"]
    return rounded(_rows(spark, [{"intercept": float(b[0]), "slope": float(b[1])}], "intercept double, slope double"), slope=6)


@query
def rdd_uniform(spark, sf_dir):
    got = regression.sharp_rdd(_lines(spark, sf_dir), "x", "y", cutoff=25.5, bandwidth=10.0, kernel="uniform")
    return rounded(_rows(spark, [got], "effect double, n_left long, n_right long"))


@query
def rdd_robust(spark, sf_dir):
    f = _lines(spark, sf_dir)
    h = regression.mse_bandwidth(f, "x", "y", cutoff=25.5)
    got = regression.robust_rdd(f, "x", "y", cutoff=25.5, bandwidth=max(h, 5.0)) | {"density_z": regression.manipulation_test(f, "x", cutoff=25.5)["z"]}
    return rounded(_rows(spark, [got], "effect double, std_error double, bias double, ci_low double, ci_high double, density_z double"))


def _scored(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("y"), (F.col("o_custkey") % 2).cast("double").alias("d"), (F.col("o_orderkey") * 7919 % 1000).cast("double").alias("score"))


@query
def qini_curve(spark, sf_dir):
    return rounded(targeting.qini_curve(_scored(spark, sf_dir), y="y", treatment="d", score="score", id_column="id"), fraction=8, qini=2)


@query
def qini_area(spark, sf_dir):
    return rounded(targeting.auuc(targeting.qini_curve(_scored(spark, sf_dir), y="y", treatment="d", score="score", id_column="id")), auuc=2, auuc_random=2, qini_coefficient=2)


@query
def policy_value(spark, sf_dir):
    g = _scored(spark, sf_dir).withColumn("gamma", F.col("d") * F.col("y") / 0.5 - (1 - F.col("d")) * F.col("y") / 0.5)
    return rounded(targeting.policy_value(g, targeting.threshold_rule("score", 500.0)), share=6)


@query
def top_share(spark, sf_dir):
    return targeting.top_share(_scored(spark, sf_dir), "score", "id", 0.1).where("treat").select("id", "score")


@query
def rank_correlation(spark, sf_dir):
    return rounded(targeting.rank_correlation(_scored(spark, sf_dir), "y", "score"), rank_correlation=6)


@query
def effect_by_group(spark, sf_dir):
    g = _scored(spark, sf_dir).withColumn("gamma", F.col("d") * F.col("y") / 0.5 - (1 - F.col("d")) * F.col("y") / 0.5)
    return rounded(targeting.effect_by_group(g, "score", "id", 4))


@query
def score_ceiling(spark, sf_dir):
    """Areas under the curve of the score that ranks as the outcome does, and of a constant one."""
    g = _scored(spark, sf_dir).withColumn("perfect", targeting.scaled_perfect("y", 2.0))
    flat = targeting.constant_prediction(g, "y", "flat")
    area = lambda f, c: targeting.auuc(targeting.qini_curve(f, y="y", treatment="d", score=c, id_column="id")).select(F.lit(c).alias("score"), "auuc")
    return rounded(area(g, "perfect").unionByName(area(flat, "flat")), auuc=1)


def _gamma(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("gamma", F.col("d") * F.col("y") / 0.5 - (1 - F.col("d")) * F.col("y") / 0.5)


@query
def policy_bounds(spark, sf_dir):
    """Values of treating all, none, and whoever's own score is positive."""
    g = _gamma(spark, sf_dir)
    rules = {"all": targeting.constant_rule(True), "none": targeting.constant_rule(False), "positive": targeting.positive_score()}
    parts = [targeting.policy_value(g, rule).select(F.lit(name).alias("policy"), "value", "std_error", "share") for name, rule in rules.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), share=6)


@query
def policy_learner(spark, sf_dir):
    got = targeting.policy_learner(_gamma(spark, sf_dir), ["score", "y"], "id", depth=2, n_grid=8)
    got["rules"] = "; ".join(f"{c} {'>' if above else '<'} {cut:g}" for c, cut, above in got["rules"])
    return rounded(_rows(spark, [got], "rules string, in_sample double, share double, value double, std_error double, optimism double"))


@query
def conformal_intervals(spark, sf_dir):
    """Width and coverage of intervals around two plain outcome models, calibrated on even ids."""
    f = _scored(spark, sf_dir).withColumn("mu1", 150000 + F.col("score")).withColumn("mu0", F.lit(150000.0)).withColumn("propensity", 0.25 + F.col("id") % 3 / 4.0)
    out = targeting.conformal_intervals(f, y="y", d="d", mu1="mu1", mu0="mu0", propensity="propensity", calibrate=F.col("id") % 2 == 0, alpha=0.1)
    return rounded(out.groupBy("d").agg(F.count("*").alias("units"), F.avg(F.col("effect_high") - F.col("effect_low")).alias("width"), F.avg("effect_low").alias("mean_low"), F.avg("effect_high").alias("mean_high")))


def _trial(spark, sf_dir) -> DataFrame:
    """Orders as a trial: two features, a split that doesn't look at them."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 1000).alias("y"), (F.col("o_custkey") % 2).cast("double").alias("d"), (F.col("o_orderkey") * 7919 % 1000 / 1000).alias("a"), (F.month("o_orderdate") / 12).alias("b"))


def _linear():
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(solver="normal")


def _effects(scored: DataFrame) -> DataFrame:
    return rounded(scored.agg(F.avg("cate").alias("mean"), F.min("cate").alias("low"), F.max("cate").alias("high")))


@query
def s_learner(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return _effects(heterogeneity.s_learner(_trial(spark, sf_dir), y="y", d="d", features=["a"], learner=_linear))


@query
def t_learner(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return _effects(heterogeneity.t_learner(_trial(spark, sf_dir), y="y", d="d", features=["a"], learner=_linear))


@query
def x_learner(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return _effects(heterogeneity.x_learner(_trial(spark, sf_dir), y="y", d="d", features=["a"], learner=_linear))


def _nuisances(spark, sf_dir) -> DataFrame:
    from veltrial.operators import heterogeneity

    return heterogeneity.nuisances(_trial(spark, sf_dir), y="y", d="d", features=["a"], id_column="id", n_folds=2, learner=_linear, fold=F.col("id") % 2)


@query
def dml_effect(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return rounded(_rows(spark, [heterogeneity.dml_effect(_nuisances(spark, sf_dir), "y", "d")], "effect double, std_error double, n long"))


@query
def r_learner(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return _effects(heterogeneity.r_learner(_nuisances(spark, sf_dir), y="y", d="d", features=["a"], learner=_linear))


@query
def dr_learner(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return _effects(heterogeneity.dr_learner(_nuisances(spark, sf_dir), y="y", d="d", features=["a"], learner=_linear))


@query
def plugin_effect(spark, sf_dir):
    from veltrial.operators import heterogeneity

    return rounded(_rows(spark, [{"effect": heterogeneity.plugin_effect(_trial(spark, sf_dir), "y", "d", ["a", "b"])}], "effect double"))


@query
def rerandomised_effects(spark, sf_dir):
    from veltrial.operators import simulate

    return rounded(simulate.rerandomise(warehouse(spark, sf_dir).dwd_experiment_user, _salts(spark, 20)), p_value=6)


def _salts(spark, n: int) -> DataFrame:
    return spark.createDataFrame([(f"s{i:03d}",) for i in range(n)], "salt string")


# ---- calibration ---------------------------------------------------------------------


@query
def aa_calibration(spark, sf_dir):
    """False rejections over splits of exp_a's users anew: a split has one experiment's users."""
    from veltrial.operators import simulate

    users = warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_a'")
    return rounded(simulate.split_calibration(users, _salts(spark, 100)))


@query
def cluster_calibration(spark, sf_dir):
    from veltrial.operators import simulate

    users = warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_city'")
    return rounded(simulate.cluster_calibration(users, _salts(spark, 60)))


@query
def stopping_rules(spark, sf_dir):
    from veltrial.operators import simulate

    users = warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_a'")
    return rounded(simulate.stopping_calibration(users, _salts(spark, 100)))


def _exp_a(spark, sf_dir) -> DataFrame:
    return warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_a'")


@query
def calibration_by_look(spark, sf_dir):
    """False rejections, coverage and false stops at each look of splits that did nothing."""
    from veltrial.operators import simulate

    return rounded(simulate.look_calibration(_exp_a(spark, sf_dir), _salts(spark, 60)), mean_z=3, sd_z=3)


@query
def power_by_look(spark, sf_dir):
    """The same with a lift of 30 per cent drawn by the salt: rejections are power."""
    from veltrial.operators import simulate

    return rounded(simulate.look_calibration(_exp_a(spark, sf_dir), _salts(spark, 60), lift=0.3), mean_z=3, sd_z=3)


@query
def cluster_calibration_by_look(spark, sf_dir):
    from veltrial.operators import simulate

    users = warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_city'")
    return rounded(simulate.cluster_look_calibration(users, _salts(spark, 30)), mean_z=3, sd_z=3)


@query
def constant_boundary(spark, sf_dir):
    """Fitted on one half of the salts, judged on the other."""
    from veltrial.operators import simulate

    salts = _salts(spark, 100)
    return rounded(simulate.constant_boundary(_exp_a(spark, sf_dir), salts.where("salt < 's050'"), salts.where("salt >= 's050'")))


@query
def share_dispersion(spark, sf_dir):
    from veltrial.operators import simulate

    return rounded(simulate.share_dispersion(_exp_a(spark, sf_dir), _salts(spark, 40)), over_p=6, under_p=6)


@query
def layer_orthogonality(spark, sf_dir):
    """Every two of eight salts over all customers."""
    from veltrial.operators.assignment import orthogonality, salt_pairs

    units = read(spark, sf_dir, "customer").select(F.format_string("u%07d", "c_custkey").alias("user_id"))
    return rounded(orthogonality(salt_pairs(units, [f"layer{i}" for i in range(8)])), p_value=6)


@query
def rejection_convergence(spark, sf_dir):
    from veltrial.operators import simulate

    users = warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_a'")
    hits = simulate.rerandomise(users, _salts(spark, 40)).withColumn("hit", F.col("p_value") < 0.05)
    return rounded(simulate.convergence(hits, "hit", "salt"), rate=6)


@query
def sample_ratio_replicates(spark, sf_dir):
    from veltrial.operators import simulate

    users = warehouse(spark, sf_dir).dwd_experiment_user.where("experiment = 'exp_a'").select("user_id")
    counts = simulate.resplit(users, _salts(spark, 20)).groupBy(*ARM).agg(F.count("*").alias("n")).withColumn("design_weight", F.lit(0.5))
    return rounded(simulate.sample_ratio_replicates(counts, "s0"), p_value=6)


@query
def hash_uniformity(spark, sf_dir):
    from veltrial.operators import simulate

    units = read(spark, sf_dir, "customer").select(F.format_string("u%07d", "c_custkey").alias("user_id"))
    salts = spark.createDataFrame([(f"salt{i}",) for i in range(20)], "salt string")
    return rounded(simulate.hash_uniformity(units, salts), p_value=6)


@query
def synthetic_control(spark, sf_dir):
    """Yearly revenue of nations as units of a small panel; the last year, cut off in August, is left out."""
    from veltrial.operators import synthetic

    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("unit"))
    o = read(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") - 1994).alias("period"), F.col("o_totalprice").cast("double").alias("v")).where("period <= 6")
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("unit", "period").agg((F.sum("v") / 1e6).alias("outcome"))
    full = p.join(p.groupBy("unit").agg(F.count("*").alias("n")).where("n = 6").select("unit"), "unit", "left_semi")
    return rounded(synthetic.placebo_inference(full, "0", 5))


# ---- ranks by key, comparison, heterogeneity over the whole table ----------------------


@query
def nested_prefixes(spark, sf_dir):
    """Four prefixes of each arm in the order of the assignment hash."""
    from veltrial.functions.hashing import murmur3_32

    users = warehouse(spark, sf_dir).dwd_experiment_user
    order = murmur3_32(F.concat(F.lit("order:"), F.col("user_id")))
    return rounded(looks.nested_prefixes(users, 4, order=order))


@query
def line_quantiles(spark, sf_dir):
    """Exact tenth, median and ninth decile of the price of lines by ship mode and return flag."""
    from veltrial.operators.ranks import quantiles_by_key

    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return rounded(quantiles_by_key(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.1, 0.5, 0.9]))


@query
def value_distance(spark, sf_dir):
    """Values of purchases in the first and the second half of the month."""
    from veltrial.operators import compare

    log = events.sources(spark, sf_dir)["event_log"].where("event_name = 'purchase'")
    half = F.dayofmonth("ds") <= 15
    return rounded(compare.kolmogorov_distance(log.where(half), log.where(~half), "metric_value"), distance=8, p_value=6)


def _halves(spark, sf_dir) -> list[Warehouse]:
    """Two warehouses of one table: users with even and with odd numbers."""
    s = events.sources(spark, sf_dir)
    part = lambda k: {n: f.where(F.col("user_id").cast("long") % 2 == k) if "user_id" in f.columns else f for n, f in s.items()}
    return [Warehouse(part(k), events.METRIC_EVENT, events.WINDOW_DAYS, events.WINDOW_DAYS) for k in (0, 1)]


@query
def warehouse_days(spark, sf_dir):
    from veltrial.operators import compare

    even, odd = _halves(spark, sf_dir)
    got = compare.days_side_by_side(even.dws_experiment_variant_daily, odd.dws_experiment_variant_daily)
    return rounded(got.where("experiment = 'exp_a'"), left_z=3, right_z=3, gap_z=3)


@query
def warehouse_shapes(spark, sf_dir):
    from veltrial.operators import compare

    even, odd = _halves(spark, sf_dir)
    return rounded(compare.shape(even.dwd_experiment_user, "even").unionByName(compare.shape(odd.dwd_experiment_user, "odd")), zero_share=6)


def _judged(spark, sf_dir) -> DataFrame:
    from veltrial.operators import splits

    return splits.judged(_trial(spark, sf_dir), y="y", d="d", features=["a"], id_column="id", propensity=0.5, n_splits=10)


@query
def linear_predictor(spark, sf_dir):
    """Mean effect and slope on the proxy, medians over ten splits."""
    from veltrial.operators import splits

    rows = splits.best_linear_predictor(_judged(spark, sf_dir))
    terms = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("value"), F.col(f"{t}_se").alias("error")) for t in ("effect", "slope")])).alias("t")).select("t.*")
    return rounded(splits.over_splits(terms, ["term"], "value", "error").select("splits", "estimate", "low", "high", "term"), estimate=3, low=3, high=3)


@query
def sorted_effects(spark, sf_dir):
    """Effects of four groups by the proxy, medians over ten splits."""
    from veltrial.operators import splits

    return rounded(splits.over_splits(splits.sorted_groups(_judged(spark, sf_dir)), ["group"], "effect", "std_error"), estimate=3, low=3, high=3)


def _forest_plan(**more):
    from veltrial.operators.forest import Plan

    return Plan(("a", "b"), (tuple(k / 16 for k in range(1, 16)), tuple(k / 12 for k in range(1, 12))), **more)


@query
def forest_first_level(spark, sf_dir):
    """First split of eight honest trees, with the effects of the other half on both sides."""
    from veltrial.operators import forest

    grown = forest.grow(_trial(spark, sf_dir), _forest_plan(bags=4, bag_trees=2, depth=1, min_leaf=20), y="y", d="d", id_column="id")
    return rounded(forest.splits_table(grown, spark), gain=2)


@query
def forest_effects(spark, sf_dir):
    """Effects of a forest of depth 3 by twelfths of the year, with their mean error."""
    from veltrial.operators import forest

    rows = _trial(spark, sf_dir)
    grown = forest.grow(rows, _forest_plan(bags=8, bag_trees=3, depth=3, min_leaf=20), y="y", d="d", id_column="id")
    out = forest.predict(rows, grown).groupBy(F.round(F.col("b") * 12).cast("int").alias("month"))
    return rounded(out.agg(F.count("*").alias("n"), F.avg("cate").alias("effect"), F.avg("cate_se").alias("error")))
