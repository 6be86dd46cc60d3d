"""Ranks and quantiles within keys of any size, without one task a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that each key's hashes are cut into, and relative accuracy of the sketch that brackets a quantile.
RANGES, ACCURACY = 1024, 10_000
#: Keys whose brackets are sent to all rows, and parts that a key's rows are cut into where there are more.
FEW_KEYS, SLICES = 20_000, 64


def hashed_ranks(rows: DataFrame, keys: list[str], hashed: Column, tie: str, *, bits: int = 32, ranges: int = RANGES) -> DataFrame:
    """Adds ``rank`` (from 1) and ``total`` within keys, by ``hashed`` (uniform over
    ``bits`` bits) and then ``tie``.  Hashes are cut into equal ranges; a range is
    ranked by itself and shifted by the counts before it."""
    cut = rows.withColumn("_h", hashed.cast("long")).withColumn("_range", F.floor(F.col("_h") / F.lit(2**bits // ranges)))
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_h", tie))
    return cut.withColumn("_inside", inside).join(starts, [*keys, "_range"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_h", "_range", "_inside", "_before")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, q: float = 0.5, accuracy: int = ACCURACY, few_keys: bool | None = None) -> DataFrame:
    """keys, n and ``quantile``: one share of ``quantiles_by_key``."""
    return quantiles_by_key(rows, keys, value, [q], accuracy, few_keys).drop("q")


def quantiles_by_key(rows: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = ACCURACY, few_keys: bool | None = None) -> DataFrame:
    """keys, n, ``quantile`` and its share ``q``: exact, between the two nearest
    values as SQL's percentile_cont; NULLs are left out.

    A sketch brackets each quantile within 2 / accuracy of the ranks on either side
    (it is off by 1 / accuracy at most); one more pass counts what lies between the
    brackets and the few values inside, of which the right ones are taken.  A key of
    fewer than 2 * accuracy rows is its own bracket.

    The brackets go to the rows while they are few (``few_keys``: they are, or not;
    None: they are computed and counted).  Else rows and brackets meet by key and a
    hash of the value, so that no key's rows gather in one task."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    d = 2.0 / accuracy
    marks = F.percentile_approx("_v", F.array(*[F.lit(m) for q in shares for m in (max(0.0, q - d), min(1.0, q + d))]), accuracy)
    bracket = rows.groupBy(*keys).agg(F.count("*").alias("n"), marks.alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    few = F.col("n") < 2 * accuracy
    low = [F.when(few | F.lit(q <= d), F.col("_least")).otherwise(F.col("_m")[2 * i]) for i, q in enumerate(shares)]
    high = [F.when(few | F.lit(q >= 1 - d), F.col("_most")).otherwise(F.col("_m")[2 * i + 1]) for i, q in enumerate(shares)]
    bracket = bracket.select(*keys, "n", *[c.alias(f"_{side}{i}") for side, cs in (("low", low), ("high", high)) for i, c in enumerate(cs)])
    if few_keys is None:
        bracket = bracket.persist()  # a row a key, read again by the join
        few_keys = bracket.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    if few_keys:
        near = rows.join(F.broadcast(bracket), keys)
    else:
        slices = bracket.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        near = rows.withColumn("_slice", F.pmod(F.xxhash64("_v"), F.lit(SLICES)).cast("int")).join(slices, [*keys, "_slice"])
    inside = F.lit(False)
    for i in range(len(shares)):
        inside = inside | F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}"))
    gap = sum(((F.col("_v") > F.col(f"_high{i}")).cast("int") for i in range(len(shares))), F.lit(0))
    # one row a key for all that lies between two brackets, one for each value inside
    cells = near.select(*keys, "n", "_v", F.when(inside, F.col("_v")).alias("_in"), F.when(~inside, gap).alias("_gap"))
    values = cells.groupBy(*keys, "n", "_in", "_gap").agg(F.count("*").alias("_c"), F.min("_v").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)
    upto = values.withColumn("_upto", F.sum("_c").over(w))
    place = [(F.col("n") - 1) * F.lit(q) for q in shares]
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_in")))
    picked = upto.groupBy(*keys, "n").agg(*[at(side(p)).alias(f"_{name}{i}") for i, p in enumerate(place) for name, side in (("a", F.floor), ("b", F.ceil))])
    found = [F.struct(F.lit(q).alias("q"), (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (p - F.floor(p))).alias("quantile")) for i, (q, p) in enumerate(zip(shares, place, strict=True))]
    return picked.select(*keys, "n", F.explode(F.array(*found)).alias("_f")).select(*keys, "n", "_f.quantile", "_f.q")
