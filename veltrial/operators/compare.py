"""Two warehouses side by side: is the one made like the other?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veltrial.functions import distributions as dist
from veltrial.operators import inference, looks

#: Ranges that the values are cut into, and the sketch's accuracy.
RANGES, ACCURACY = 256, 2000


def _kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Tail of the limit law at sqrt(n m / (n + m)) D."""
    x = F.sqrt(n * m / (n + m)) * d
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def kolmogorov_distance(left: DataFrame, right: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """n_left, n_right, distance (largest gap of the two distribution functions),
    at (the least value where it is reached) and p_value; NULLs are left out.

    Values are cut into ranges by a sketch of both samples; the ranges' counts give
    what lies before each, and inside a range distinct values are added up in order.
    Equal values are one row before they are exchanged, so a value that most rows
    have is one row a task."""
    both = left.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"))).where("v IS NOT NULL")
    cells = both.groupBy("v").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    cuts = both.agg(F.percentile_approx("v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), ACCURACY).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))  # at most ``ranges`` numbers
    marks = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    placed = cells.withColumn("_range", F.aggregate(marks, F.lit(0), lambda n, c: n + (F.col("v") > c).cast("int")))
    sums = placed.groupBy("_range").agg(F.sum("l").alias("_l"), F.sum("r").alias("_r"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    whole = Window.partitionBy()
    starts = sums.select("_range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in ("_l", "_r")], F.sum("_l").over(whole).alias("n_left"), F.sum("_r").over(whole).alias("n_right"))
    upto = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("_range", "v", F.sum("l").over(upto).alias("l"), F.sum("r").over(upto).alias("r")).join(starts, "_range")
    gap = F.abs((F.col("l") + F.col("_l0")) / F.col("n_left") - (F.col("r") + F.col("_r0")) / F.col("n_right"))
    best = run.select("n_left", "n_right", gap.alias("distance"), "v").groupBy("n_left", "n_right").agg(F.max("distance").alias("distance"), F.max_by(F.col("v"), F.struct(F.round("distance", 12), -F.col("v"))).alias("at"))
    return best.withColumn("p_value", _kolmogorov_p(F.col("distance"), F.col("n_left").cast("double"), F.col("n_right").cast("double")))


def day_scores(daily: DataFrame, control: str = "control") -> DataFrame:
    """experiment, variant, ds, effect, std_error, z of the sums up to each day."""
    run = looks.cumulative(daily).where("n > 1").withColumn("experiment", F.struct("experiment", "ds")).drop("ds")
    rows = inference.welch(inference.contrasts(run, control)).select("experiment.experiment", "experiment.ds", "variant", "effect", "std_error")
    return rows.withColumn("z", F.try_divide("effect", "std_error"))


def days_side_by_side(left: DataFrame, right: DataFrame, control: str = "control") -> DataFrame:
    """The day-by-day scores of two warehouses' daily layers by number of day, as
    their calendars differ, with the test of equal effects at each."""
    def numbered(daily: DataFrame, p: str) -> DataFrame:
        scores = day_scores(daily, control)
        first = Window.partitionBy("experiment", "variant")
        return scores.select("experiment", "variant", (F.datediff("ds", F.min("ds").over(first)) + 1).alias("day"), *[F.col(c).alias(f"{p}_{c}") for c in ("effect", "std_error", "z")])

    both = numbered(left, "left").join(numbered(right, "right"), ["experiment", "variant", "day"], "full")
    gap = (F.col("left_effect") - F.col("right_effect")) / F.sqrt(F.col("left_std_error") ** 2 + F.col("right_std_error") ** 2)
    return both.withColumn("gap_z", gap).withColumn("gap_p", dist.normal_two_sided(F.col("gap_z")))


def shape(users: DataFrame, name: str) -> DataFrame:
    """Moments, zeros and the heaviest user of the metric of a warehouse's users."""
    y = F.col("post_metric")
    return users.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.avg(F.when(y == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.try_divide(F.max(y), F.avg(y)).alias("max_over_mean")).select(F.lit(name).alias("warehouse"), "*")
