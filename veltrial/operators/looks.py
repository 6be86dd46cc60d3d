"""Looks at running experiments: cumulative sums by day, aligned on dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = {"n": "user_cnt", "sum_x": "pre_sum", "sum_y": "post_sum", "sum_xx": "pre_sq_sum", "sum_yy": "post_sq_sum", "sum_xy": "pre_post_cross_sum"}
RATIO_SUMS = {"n": "user_cnt", "sum_x": "sum_x", "sum_y": "sum_y", "sum_xx": "sum_xx", "sum_yy": "sum_yy", "sum_xy": "sum_xy"}


def on_spine(daily: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Every day of an experiment for each of its keys, with 0 where nothing
    came, so that arms with different days are aligned by date, not by place."""
    days = daily.groupBy("experiment").agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select("experiment", F.explode(F.sequence("a", "b")).alias("ds"))
    cells = daily.select(*keys).distinct().join(days, "experiment")
    return cells.join(daily, [*keys, "ds"], "left").select(*keys, "ds", *[F.coalesce(s, F.lit(0)).alias(s) for s in sums])


def cumulative(daily: DataFrame, keys: list[str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Running sums over the date spine of each key."""
    keys, sums = keys or ["experiment", "variant"], sums or SUMS
    w = Window.partitionBy(*keys).orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return on_spine(daily, keys, list(sums.values())).select(*keys, "ds", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])


def information(cumulated: DataFrame, by: str = "n") -> DataFrame:
    """Share of the final information each day: users, or another column summed over arms."""
    total = cumulated.groupBy("experiment", "ds").agg(F.sum(by).alias("_i"))
    return total.withColumn("info", F.col("_i") / F.max("_i").over(Window.partitionBy("experiment"))).drop("_i")


def pick_looks(info: DataFrame, n_looks: int) -> DataFrame:
    """Days nearest to k / n_looks (the earlier on a tie), and the last day;
    each once, numbered, the last at exactly 1."""
    targets = info.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_looks)))).withColumn("off", F.abs(F.col("info") - F.col("k") / F.lit(float(n_looks))))
    near = targets.withColumn("r", F.row_number().over(Window.partitionBy("experiment", "k").orderBy("off", "ds"))).where("r = 1").select("experiment", "ds", "info")
    last = info.groupBy("experiment").agg(F.max("ds").alias("ds"), F.max_by("info", "ds").alias("info"))
    picked = near.unionByName(last).groupBy("experiment", "info").agg(F.min("ds").alias("ds"))
    w = Window.partitionBy("experiment").orderBy("info")
    return picked.withColumn("look", F.row_number().over(w)).select("experiment", "look", "ds", "info")


def look_arms(daily: DataFrame, n_looks: int, sums: dict[str, str] | None = None, by: str = "n") -> DataFrame:
    """Arms tables of the picked looks: experiment, variant, look, info and sums up to it."""
    run = cumulative(daily, sums=sums)
    picks = pick_looks(information(run, by), n_looks)
    return run.join(picks, ["experiment", "ds"])  # n_looks rows an experiment: AQE broadcasts them while they are few


def cluster_looks(daily: DataFrame, n_looks: int) -> DataFrame:
    """Cumulative sums of each cluster at each look; information is the number
    of clusters seen, and only days with two clusters in each arm count."""
    run = cumulative(daily, ["experiment", "variant", "cluster_id"]).where("n > 0")
    seen = run.groupBy("experiment", "variant", "ds").agg(F.count("*").alias("clusters"))
    per_day = seen.groupBy("experiment", "ds").agg(F.sum("clusters").alias("c"), F.min("clusters").alias("least"), F.count("*").alias("arms"))
    fit = per_day.where("least >= 2 AND arms >= 2").withColumn("info", F.col("c") / F.max("c").over(Window.partitionBy("experiment"))).select("experiment", "ds", "info")
    return run.join(pick_looks(fit, n_looks), ["experiment", "ds"])


def clusters_agree(clusters: DataFrame, arms: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Looks at which the sums of the clusters leave those of the arms."""
    total = clusters.groupBy("experiment", "variant", "ds").agg(F.sum("n").alias("cn"), F.sum("sum_y").alias("cy"))
    both = arms.join(total, ["experiment", "variant", "ds"])
    return both.where((F.col("n") != F.col("cn")) | (F.abs(F.col("sum_y") - F.col("cy")) > tol * F.greatest(F.lit(1.0), F.abs("sum_y"))))


def nested_prefixes(users: DataFrame, n_looks: int, *, id_column: str = "user_id", seed: int = 0, order: Column | None = None) -> DataFrame:
    """Prefix sums over a random order of entry, cut at equal shares of each arm:
    the order is a 32-bit hash of the id (or ``order``), so a retry gives the same
    looks; ranks are found range by range, so an arm may be of any size."""
    from veltrial.operators.inference import moments
    from veltrial.operators.ranks import hashed_ranks

    order = F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.lit(seed)), 32) if order is None else order
    ranked = hashed_ranks(users, ["experiment", "variant"], order, id_column)
    small = F.floor(F.col("total") / n_looks)
    larger = F.col("total") % n_looks  # as many shares have one more
    wide = larger * (small + 1)
    look = F.when(F.col("rank") <= wide, F.ceil(F.col("rank") / (small + 1))).otherwise(larger + F.ceil((F.col("rank") - wide) / F.greatest(small, F.lit(1)))).cast("int")
    cells = ranked.withColumn("look", look).groupBy("experiment", "variant", "look").agg(*moments("post_metric", "pre_metric"))
    run = Window.partitionBy("experiment", "variant").orderBy("look").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("experiment", "variant", "look", *[F.sum(c).over(run).alias(c) for c in ("n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")])


def look_problems(arms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(experiment, problem): why looks can't be judged.  arms: rows of
    ``look_arms``; clusters: experiment, variant, n clusters (cluster designs)."""
    looks = arms.groupBy("experiment", "look").agg(F.min("info").alias("info"), F.min("n").alias("least"), F.countDistinct("variant").alias("arms"))
    w = Window.partitionBy("experiment").orderBy("look")
    steps = looks.withColumn("before", F.lag("info").over(w)).withColumn("most_arms", F.max("arms").over(Window.partitionBy("experiment")))
    found = steps.groupBy("experiment").agg(
        F.max((F.col("info") <= F.col("before")).cast("int")).alias("information does not rise"), (F.abs(F.max("info") - 1) > 1e-9).cast("int").alias("the last look is not at full information"),
        F.max((F.col("least") < 2).cast("int")).alias("an arm has fewer than two units"), F.max((F.col("arms") < F.greatest(F.col("most_arms"), F.lit(2))).cast("int")).alias("an arm is missing from a look"),
    )
    if clusters is not None:
        few = clusters.groupBy("experiment").agg(F.max((F.col("n") < 2).cast("int")).alias("an arm has fewer than two clusters"))
        found = found.join(few, "experiment", "left")
    names = [c for c in found.columns if c != "experiment"]
    rows = found.select("experiment", F.explode(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in names])).alias("problem"))
    return rows.where("problem IS NOT NULL")
