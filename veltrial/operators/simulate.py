"""Calibration on the warehouse's own users: each salt splits them anew, so every
effect that is found is false.

The salts are a stated, short list.  Users meet them where they are, are summed
there by salt and arm (and day), and only those sums are exchanged; what comes
back is one row a salt (and look).  Rates and their intervals are
aggregates over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veltrial.functions.special import normal_ppf

#: Tasks for the sums by salt, arm and day or look: a few rows a salt, which no
#: more users make more.  Every task of the tests has Python workers of its own.
FEW_TASKS = 4


def wilson(rows: DataFrame, hit: str, alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Rate of a boolean with its Wilson interval."""
    z = normal_ppf(1 - alpha / 2)
    s = rows.groupBy(*by).agg(F.count("*").alias("trials"), F.sum(F.col(hit).cast("long")).alias("hits"))
    n, p = F.col("trials"), F.col("hits") / F.col("trials")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return s.select(*by, "trials", "hits", p.alias("rate"), (centre - half).alias("low"), (centre + half).alias("high"))


def convergence(rows: DataFrame, hit: str, order: str) -> DataFrame:
    """Rate of a boolean over the first 1, 2, ... replicates (one row each)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.row_number().over(w).alias("replicates"), F.avg(F.col(hit).cast("double")).over(w).alias("rate"))


def hash_uniformity(units: DataFrame, salts: DataFrame, unit: str = "user_id", n_buckets: int = 100) -> DataFrame:
    """Chi-square of each salt's buckets over all units."""
    from veltrial.functions import distributions as dist
    from veltrial.operators.assignment import BUCKETS, assign_salts

    hashed = assign_salts(units, salts, unit).withColumn("cell", F.floor(F.col("bucket") * n_buckets / BUCKETS))
    counts = hashed.groupBy("salt", "cell").agg(F.count("*").alias("n"))
    s = counts.groupBy("salt").agg(F.sum("n").alias("units"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    chi2 = F.col("nn") * n_buckets / F.col("units") - F.col("units")
    return s.select("salt", "units", chi2.alias("chi2")).withColumn("p_value", dist.chi2_sf(F.col("chi2"), F.lit(float(n_buckets - 1))))


def ramp_is_nested(units: DataFrame, experiment, ratios: tuple[float, ...], unit: str = "user_id") -> DataFrame:
    """For each step of a ramp: units that left or changed arm (both must be 0)."""
    from dataclasses import replace

    from veltrial.operators.assignment import assign

    out = None
    for a, b in zip(ratios, ratios[1:], strict=False):
        low = assign(units.select(unit), replace(experiment, traffic_ratio=a), unit).select(unit, F.col("variant").alias("before"))
        both = assign(low, replace(experiment, traffic_ratio=b), unit)
        step = both.agg(F.sum((F.col("before").isNotNull() & F.col("variant").isNull()).cast("long")).alias("left"), F.sum((F.col("before") != F.col("variant")).cast("long")).alias("changed"), F.count("variant").alias("enrolled")).select(F.lit(a).alias("from_ratio"), F.lit(b).alias("to_ratio"), "left", F.coalesce("changed", F.lit(0)).alias("changed"), "enrolled")
        out = step if out is None else out.unionByName(step)
    return out


def rerandomise(users: DataFrame, salts: DataFrame, *, unit: str = "user_id", y: str = "post_metric", x: str = "pre_metric") -> DataFrame:
    """The users of each experiment split anew under each salt: plain and
    adjusted effects of splits that did nothing."""
    from veltrial.operators.assignment import BUCKETS, assign_salts
    from veltrial.operators.inference import contrasts, cuped, moments, welch, with_test

    cells = assign_salts(users.select("experiment", unit, y, x), salts, unit)
    arm = F.when(F.col("bucket") < BUCKETS // 2, "control").otherwise("treatment")
    pairs = contrasts(cells.groupBy(F.struct("experiment", "salt").alias("experiment"), arm.alias("variant")).agg(*moments(y, x)))
    adjusted = cuped(pairs).select("experiment", F.col("effect").alias("adjusted_effect"), F.col("std_error").alias("adjusted_std_error"))
    return with_test(welch(pairs)).join(adjusted, "experiment").select("experiment.experiment", "experiment.salt", "effect", "std_error", "p_value", "adjusted_effect", "adjusted_std_error")


def resplit(users: DataFrame, salts: DataFrame, unit: str = "user_id") -> DataFrame:
    """users under every salt: experiment is the salt, variant the new arm."""
    from veltrial.operators.assignment import BUCKETS, assign_salts

    hashed = assign_salts(users.drop("experiment", "variant"), salts, unit)
    arm = F.when(F.col("bucket") < BUCKETS // 2, "control").otherwise("treatment")
    return hashed.withColumn("experiment", F.col("salt")).withColumn("variant", arm).drop("salt", "hash", "bucket")


def _sums(y: Column, x: Column, prefix: str = "") -> list[Column]:
    named = {"sum_x": x, "sum_y": y, "sum_xx": x * x, "sum_yy": y * y, "sum_xy": x * y}
    return [F.sum(c.cast("double")).alias(prefix + k) for k, c in named.items()]


def _estimates(arms: DataFrame, alpha: float) -> DataFrame:
    """experiment, test, effect, std_error, t_statistic, p_value of the plain, the
    adjusted and the ratio test of arms with n, sum_* and ratio_sum_*.  All rows are
    tested in one place: a task has one Python worker, whatever the tests."""
    from veltrial.operators.inference import MOMENTS, contrasts, cuped, ratio_delta, welch, with_test

    rest = MOMENTS[1:]
    pairs = contrasts(arms.select("experiment", "variant", *MOMENTS))
    ratios = contrasts(arms.select("experiment", "variant", "n", *[F.col(f"ratio_{m}").alias(m) for m in rest]))
    rows = None
    for name, frame in (("plain", welch(pairs)), ("adjusted", cuped(pairs)), ("ratio", ratio_delta(ratios))):
        one = frame.select("experiment", F.lit(name).alias("test"), "effect", "std_error", F.col("df").cast("double").alias("df"))
        rows = one if rows is None else rows.unionByName(one)
    tested = with_test(rows.repartition(FEW_TASKS, "experiment"), alpha).select("experiment", "test", "effect", "std_error", "t_statistic", "p_value", "ci_low", "ci_high")
    return tested.persist()  # a row a salt, look and test: conditions on the p-value read it, they don't work it out again


def split_calibration(users: DataFrame, salts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rejections of the plain, the adjusted and the ratio test over all salts,
    with the moments of z: its mean and spread tell an honest error from a wrong one."""
    y, x, k = F.col("post_metric"), F.col("pre_metric"), F.col("post_cnt")
    arms = resplit(users, salts).groupBy("experiment", "variant").agg(F.count("*").alias("n"), *_sums(y, x), *_sums(y, k, "ratio_")).persist()  # salts x arms, read by both sides of every test
    rows = _estimates(arms, alpha).withColumn("hit", F.col("p_value") < alpha).where(F.col("hit").isNotNull())
    z = rows.groupBy("test").agg(F.avg("t_statistic").alias("mean_z"), F.stddev_samp("t_statistic").alias("sd_z"))
    return wilson(rows, "hit", by=("test",)).join(z, "test")


def cluster_calibration(users: DataFrame, salts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Clusters split anew: rejections of the user-level and the cluster-level test."""
    from veltrial.operators.clusters import cluster_means
    from veltrial.operators.inference import contrasts, moments, welch, with_test

    known = users.where(F.col("city").isNotNull()).select("city", "pre_metric", "post_metric")
    totals = resplit(known, salts, "city").groupBy("experiment", "variant", F.col("city").alias("cluster_id")).agg(*moments("post_metric", "pre_metric"))
    by_user = totals.groupBy("experiment", "variant").agg(*[F.sum(m).alias(m) for m in ("n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")])
    rows = None
    for name, frame in (("user", by_user), ("cluster", cluster_means(totals))):
        one = with_test(welch(contrasts(frame)), alpha).select(F.lit(name).alias("unit"), (F.col("p_value") < alpha).alias("hit"))
        rows = one if rows is None else rows.unionByName(one)
    return wilson(rows.where(F.col("hit").isNotNull()), "hit", by=("unit",))


def replicate_looks(users: DataFrame, salts: DataFrame, *, n_looks: int = 5, lift: float = 0.0) -> DataFrame:
    """Arms of every split at its looks: experiment (the salt), variant, look,
    info, n, sum_*, ratio_sum_* up to the look, and the true effects of the lift.

    Both outcomes of a user are at hand, y and y * (1 + lift); the salt draws which
    one is seen.  Users are summed by salt, arm and day before anything is exchanged,
    so what the looks are made of doesn't grow with the users."""
    from veltrial.operators.looks import cumulative, information, pick_looks

    treated = F.col("variant") == "treatment"
    y0, x, k = F.col("post_metric"), F.col("pre_metric"), F.col("post_cnt")
    y = F.when(treated, y0 * (1 + lift)).otherwise(y0)
    split = resplit(users.select("user_id", "expose_ds", "pre_metric", "post_metric", "post_cnt"), salts)
    daily = split.groupBy("experiment", "variant", F.col("expose_ds").alias("ds")).agg(F.count("*").alias("n"), *_sums(y, x), *_sums(y, k, "ratio_"), F.sum(y0).alias("untreated"))
    daily = daily.repartition(FEW_TASKS, "experiment").persist()  # salts x arms x days: the spine reads them three times, the users are hashed once
    names = [c for c in daily.columns if c not in ("experiment", "variant", "ds")]
    run = cumulative(daily, sums={c: c for c in names}).repartition(FEW_TASKS, "experiment").persist()  # salts x arms x days: read by the picks and by every test
    arms = run.join(pick_looks(information(run), n_looks), ["experiment", "ds"])
    here = Window.partitionBy("experiment", "look")
    total = lambda c: F.sum(c).over(here)
    return arms.withColumn("true_mean", lift * total("untreated") / total("n")).withColumn("true_ratio", lift * F.try_divide(total("untreated"), total("ratio_sum_x"))).drop("ds", "untreated").repartition(FEW_TASKS, "experiment").persist()  # salts x arms x looks, read by both sides of every test


def look_calibration(users: DataFrame, salts: DataFrame, *, n_looks: int = 5, lift: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """By test and look, over all salts: how often the test rejects there, how often
    its interval covers the true effect, how often the group-sequential rule has
    stopped by then, and the moments of z about the truth.  Without a lift rejections
    are false; with one they are power."""
    from veltrial.operators.sequential import monitor

    arms = replicate_looks(users, salts, n_looks=n_looks, lift=lift).where("n > 1")
    key = F.struct("experiment", "look", "info", "true_mean", "true_ratio")
    rows = _estimates(arms.withColumn("experiment", key).drop("look", "info", "true_mean", "true_ratio"), alpha)
    rows = rows.select(F.struct("test", "experiment.experiment").alias("experiment"), "test", "experiment.look", "experiment.info", F.when(F.col("test") == "ratio", F.col("experiment.true_ratio")).otherwise(F.col("experiment.true_mean")).alias("truth"), "effect", "std_error", "p_value", "ci_low", "ci_high")
    judged = monitor(rows.where(F.col("p_value").isNotNull()), alpha=alpha)
    n = F.count("*")
    share = lambda c: F.avg(c.cast("double"))
    z = (F.col("effect") - F.col("truth")) / F.col("std_error")
    return judged.groupBy("test", "look").agg(
        n.alias("trials"), share(F.col("p_value") < alpha).alias("rejected"), share((F.col("ci_low") <= F.col("truth")) & (F.col("truth") <= F.col("ci_high"))).alias("covered"), share(F.col("stopped")).alias("stopped"), F.avg(z).alias("mean_z"), F.stddev_samp(z).alias("sd_z"),
    )


def cluster_look_calibration(users: DataFrame, salts: DataFrame, *, n_looks: int = 3, alpha: float = 0.05) -> DataFrame:
    """Clusters split anew, judged at looks by their number: by estimator (users as
    units, cluster means, adjusted cluster means) and look, how often a fixed test
    rejects there and how often the group-sequential rule has stopped by then."""
    from veltrial.operators.effects import cluster_effects
    from veltrial.operators.looks import cluster_looks
    from veltrial.operators.sequential import monitor

    y, x = F.col("post_metric"), F.col("pre_metric")
    known = users.where(F.col("city").isNotNull()).select("city", "expose_ds", "pre_metric", "post_metric")
    keys = ["experiment", "variant", F.col("city").alias("cluster_id"), F.col("expose_ds").alias("ds")]
    sums = {"pre_sum": x, "post_sum": y, "pre_sq_sum": x * x, "post_sq_sum": y * y, "pre_post_cross_sum": x * y}
    daily = resplit(known, salts, "city").groupBy(*keys).agg(F.count("*").alias("user_cnt"), *[F.sum(c).alias(n) for n, c in sums.items()]).persist()  # salts x clusters x days
    totals = cluster_looks(daily, n_looks).persist()  # salts x clusters x looks
    rows = None
    for name in ("unit_level", "cluster_level", "cluster_cuped"):
        one = cluster_effects(totals, name).where("std_error > 0")
        one = one.select(F.struct(F.lit(name).alias("estimator"), "experiment").alias("experiment"), "variant", "look", "info", "effect", "std_error")
        rows = one if rows is None else rows.unionByName(one)
    judged = monitor(rows, alpha=alpha)
    share = lambda c: F.avg(c.cast("double"))
    return judged.groupBy("experiment.estimator", "look").agg(
        F.count("*").alias("trials"), share(F.abs("z") > normal_ppf(1 - alpha / 2)).alias("rejected"), share(F.col("stopped")).alias("stopped"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z")
    )


def _look_rows(users: DataFrame, salts: DataFrame, n_looks: int) -> DataFrame:
    """experiment, variant, look, info, effect, std_error of the plain test."""
    from veltrial.operators.inference import MOMENTS, contrasts, welch

    arms = replicate_looks(users, salts, n_looks=n_looks).where("n > 1").withColumn("experiment", F.struct("experiment", "look", "info"))
    return welch(contrasts(arms.select("experiment", "variant", *MOMENTS))).select("experiment.*", "variant", "effect", "std_error")


def stopping_calibration(users: DataFrame, salts: DataFrame, *, n_looks: int = 5, alpha: float = 0.05, tau: float | None = None) -> DataFrame:
    """How often each stopping rule stops somewhere along the looks of splits that
    did nothing.  The group-sequential bounds are those of the looks' information;
    tau is each split's own unless given."""
    from veltrial.operators.sequential import always_valid_path, monitor

    looks = _look_rows(users, salts, n_looks)
    fixed = normal_ppf(1 - alpha / 2)
    path = always_valid_path(monitor(looks, alpha=alpha), tau, alpha)
    z = F.abs("z")
    per = path.groupBy("experiment").agg(F.max(z > fixed).alias("naive"), F.max_by(z > fixed, "look").alias("fixed"), F.max("crossed").alias("sequential"), F.max("rejected").alias("always_valid"))
    hits = per.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(False)).alias("hit")) for r in ("naive", "fixed", "sequential", "always_valid")])).alias("r")).select("r.*")
    return wilson(hits, "hit", by=("rule",))


def constant_boundary(users: DataFrame, fit: DataFrame, judge: DataFrame, *, n_looks: int = 5, alpha: float = 0.05) -> DataFrame:
    """One bound for all looks, from the data's own splits: the 1 - alpha quantile
    of the largest |z| of each path over the salts of ``fit``; false stops of that
    bound, and of the plain quantile, are counted over the salts of ``judge``."""
    largest = lambda salts: _look_rows(users, salts, n_looks).groupBy("experiment").agg(F.max(F.abs(F.try_divide("effect", "std_error"))).alias("z"))
    bound = largest(fit).agg(F.percentile("z", 1 - alpha).alias("boundary"))
    rows = largest(judge).crossJoin(F.broadcast(bound))  # one row
    return rows.agg(F.max("boundary").alias("boundary"), F.count("*").alias("trials"), F.avg((F.col("z") > F.col("boundary")).cast("double")).alias("stopped"), F.avg((F.col("z") > normal_ppf(1 - alpha / 2)).cast("double")).alias("naive"))


def share_dispersion(users: DataFrame, salts: DataFrame, share: float = 0.5) -> DataFrame:
    """Do the arm sizes of the splits spread as a coin's would?  The squares of the
    standardised sizes add up to a chi-square; its two tails tell over- and
    under-dispersion."""
    from veltrial.functions import distributions as dist

    sizes = resplit(users.select("user_id"), salts).groupBy("experiment").agg(F.count("*").alias("n"), F.count_if(F.col("variant") == "treatment").alias("t"))
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    s = sizes.agg(F.count("*").alias("splits"), F.avg(z).alias("mean_z"), F.stddev_samp(z).alias("sd_z"), F.sum(z * z).alias("chi2"))
    upper = dist.chi2_sf(F.col("chi2"), F.col("splits").cast("double"))
    return s.withColumn("over_p", upper).withColumn("under_p", 1 - F.col("over_p"))


def sample_ratio_replicates(counts: DataFrame, prefix: str = "") -> DataFrame:
    """Sample-ratio p-value of every replicate whose name begins with ``prefix``."""
    from veltrial.operators.inference import srm

    return srm(counts.where(F.col("experiment").startswith(prefix))).select("experiment", "units", "chi2", "p_value")
