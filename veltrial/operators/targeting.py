"""Uplift curves, policies and conformal intervals over scored units."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_range(frame: DataFrame, column: str, cuts: list, out: str) -> DataFrame:
    """Adds the number of cuts that are at most the value (binary search in the JVM)."""
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    wide = frame.withColumn(f"{out}_v", F.col(column).cast("double"))
    return Bucketizer(splits=splits, inputCol=f"{out}_v", outputCol=f"{out}_b").transform(wide).withColumn(out, F.col(f"{out}_b").cast("int")).drop(f"{out}_v", f"{out}_b")


def ranked(frame: DataFrame, score: str, id_column: str, chunks: int = 512) -> DataFrame:
    """Adds rank (1: best score, ties by id) and total, without sorting in one
    task: quantiles of the score cut the rows into ranges, rows are ranked in
    their range and moved up by the counts of the ranges before.  A score that
    fills whole ranges by itself is cut again by its (numeric) ids."""
    probs = [(i + 1) / chunks for i in range(chunks - 1)]
    numeric = dict(frame.dtypes)[id_column] in ("int", "bigint", "double", "smallint")
    row = frame.agg(F.percentile_approx(score, probs, 20_000).alias("s"), (F.percentile_approx(id_column, [i / 32 for i in range(1, 32)], 20_000) if numeric else F.lit(None)).alias("i")).first()
    cuts = sorted(row["s"] or [], reverse=True)
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    cut = _with_range(frame, score, cuts, "_part").withColumn("_part", -F.col("_part") * 2)
    if hot:
        cut = cut.withColumn("_hot", F.col(score).isin(hot)).withColumn("_part", F.col("_part") + F.col("_hot").cast("int"))
        if numeric:
            cut = _with_range(cut, id_column, row["i"], "_inside").withColumn("_part", F.col("_part") * 64 + F.when(F.col("_hot"), F.col("_inside")).otherwise(0)).drop("_inside")
        cut = cut.drop("_hot")
    own = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(score), F.asc(id_column))))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).withColumn("total", F.sum("_n").over(Window.partitionBy()))  # one row a range
    return own.join(F.broadcast(before.drop("_n")), "_part").withColumn("rank", F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")


def qini_curve(frame: DataFrame, *, y: str, treatment: str, score: str, id_column: str, points: int = 100) -> DataFrame:
    """Gain over the control's rate among the best-scored share, at ``points``
    shares: units are summed between the points first, so the running sums are
    over that many rows."""
    r = ranked(frame.where(F.col(y).isNotNull() & F.col(treatment).isNotNull() & F.col(score).isNotNull()), score, id_column)
    # point i of 0..k-1 stands at rank 1 + i (total - 1) div (k - 1); a unit belongs to the first point not before it
    r = r.withColumn("k", F.least(F.lit(points), F.col("total")))
    r = r.withColumn("p", F.expr("CASE WHEN k > 1 THEN ((rank - 1) * (k - 1) + total - 2) div (total - 1) ELSE 0 END"))
    r = r.withColumn("at", F.expr("CASE WHEN k > 1 THEN 1 + p * (total - 1) div (k - 1) ELSE 1 END"))
    cells = r.select("p", "at", "total", F.col(y).cast("double").alias("y"), F.col(treatment).cast("double").alias("d"))
    sums = cells.groupBy("p", "at", "total").agg(F.sum(F.col("y") * F.col("d")).alias("yt"), F.sum(F.col("y") * (1 - F.col("d"))).alias("yc"), F.sum("d").alias("nt"), F.sum(1 - F.col("d")).alias("nc"))
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # over at most ``points`` rows
    run = lambda c: F.sum(c).over(w)
    return sums.select((F.col("at") / F.col("total")).alias("fraction"), (run("yt") - F.coalesce(F.try_divide(run("yc") * run("nt"), run("nc")), F.lit(0.0))).alias("qini"))


def auuc(curve: DataFrame) -> DataFrame:
    """Area under the curve, under the straight line to its end, and the difference."""
    w = Window.orderBy("fraction")
    c = curve.withColumn("i", F.row_number().over(w)).withColumn("pf", F.lag("fraction").over(w)).withColumn("pq", F.lag("qini").over(w))
    end = F.max_by("qini", "fraction")
    area = F.coalesce(F.sum((F.col("fraction") - F.col("pf")) * (F.col("qini") + F.col("pq")) / 2), F.lit(0.0))
    s = c.agg(area.alias("auuc"), end.alias("end"), F.count("*").alias("k"))
    line = c.crossJoin(F.broadcast(s)).agg(F.coalesce(F.sum((F.col("fraction") - F.col("pf")) * F.col("end") * (2 * F.col("i") - 3) / (F.col("k") - 1) / 2), F.lit(0.0)).alias("auuc_random"))
    return s.crossJoin(line).select("auuc", "auuc_random", (F.col("auuc") - F.col("auuc_random")).alias("qini_coefficient"))


def rank_correlation(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks.  Values are counted first, and
    the ranks come from running counts over ranges of the distinct values."""

    def ranks(c: str) -> DataFrame:
        per = frame.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        cuts = per.agg(F.percentile_approx(c, [(i + 1) / 512 for i in range(511)], 20_000)).first()[0] or []
        r = _with_range(per, c, cuts, "_p")
        inside = r.withColumn("_s", F.sum("n").over(Window.partitionBy("_p").orderBy(c)))
        sizes = r.groupBy("_p").agg(F.sum("n").alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # one row a range
        return inside.join(F.broadcast(sizes.drop("_n")), "_p").select(c, (F.col("_b") + F.col("_s") - (F.col("n") - 1) / 2).alias(f"{c}_rank"))

    return frame.select(a, b).join(ranks(a), a).join(ranks(b), b).agg(F.corr(f"{a}_rank", f"{b}_rank").alias("rank_correlation"))


def scaled_perfect(effect: str, factor: float = 1.0) -> Column:
    """A score that ranks as the true effect does: the best a curve can show."""
    return F.col(effect) * F.lit(float(factor))


def constant_prediction(frame: DataFrame, effect: str, out: str = "score") -> DataFrame:
    """The mean effect for everybody: a score that ranks nobody."""
    mean = frame.agg(F.avg(effect)).first()[0]
    return frame.withColumn(out, F.lit(mean).cast("double"))


# ---- policies ----------------------------------------------------------------


def constant_rule(treat: bool) -> Column:
    """Everybody or nobody."""
    return F.lit(bool(treat))


def positive_score(gamma: str = "gamma") -> Column:
    """The rule without limits: whoever's own score is above 0."""
    return F.col(gamma) > 0


def threshold_rule(column: str, cut: float, above: bool = True) -> Column:
    return F.col(column) > cut if above else F.col(column) < cut


def any_rule(rules: list[Column]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r
    return out


def top_share(frame: DataFrame, score: str, id_column: str, share: float) -> DataFrame:
    """Adds treat: is the unit among the best round(share * total)."""
    return ranked(frame, score, id_column).withColumn("treat", F.col("rank") <= F.round(F.col("total") * share)).drop("rank", "total")


def aipw_scores(frame: DataFrame, *, y: str, d: str, mu1: str, mu0: str, propensity: str, clip: float = 0.02) -> DataFrame:
    """Adds gamma: the doubly robust effect score of each unit."""
    p = F.least(F.greatest(F.col(propensity), F.lit(clip)), F.lit(1 - clip))
    gamma = F.col(mu1) - F.col(mu0) + F.col(d) * (F.col(y) - F.col(mu1)) / p - (1 - F.col(d)) * (F.col(y) - F.col(mu0)) / (1 - p)
    return frame.withColumn("gamma", gamma)


def policy_value(scored: DataFrame, treat: Column) -> DataFrame:
    """Value of treating by a rule: mean of rule times score, with its error."""
    v = F.when(treat, F.col("gamma")).otherwise(0.0)
    return scored.agg(F.avg(v).alias("value"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("std_error"), F.avg(F.when(treat, 1.0).otherwise(0.0)).alias("share"))


def effect_by_group(scored: DataFrame, score: str, id_column: str, groups: int = 5) -> DataFrame:
    """Mean effect score in equal groups of the ranking, best first."""
    r = ranked(scored, score, id_column)
    g = F.expr(f"CAST((rank - 1) * {int(groups)} div total AS INT) + 1")
    return r.groupBy(g.alias("group")).agg(F.count("*").alias("units"), F.avg("gamma").alias("effect"), (F.stddev_samp("gamma") / F.sqrt(F.count("*"))).alias("std_error"))


def learn_threshold_policy(scored: DataFrame, columns: list[str], *, depth: int = 2, n_grid: int = 20, min_share: float = 0.0, max_share: float = 1.0) -> tuple[list[tuple[str, float, bool]], float]:
    """Greedy union of threshold rules: each round sums all candidates in one pass."""
    probs = [(i + 1) / (n_grid + 1) for i in range(n_grid)]
    cuts = scored.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in columns]).first()
    candidates = [(c, float(q), above) for c in columns for q in sorted(set(cuts[c] or [])) for above in (True, False)]
    rules: list[tuple[str, float, bool]] = []
    best = 0.0
    for _ in range(depth):
        have = any_rule([threshold_rule(*r) for r in rules])
        aggs = []
        for k, cand in enumerate(candidates):
            hit = have | threshold_rule(*cand)
            aggs += [F.avg(F.when(hit, F.col("gamma")).otherwise(0.0)).alias(f"v{k}"), F.avg(hit.cast("double")).alias(f"s{k}")]
        row = scored.agg(*aggs).first()
        fit = [(row[f"v{k}"], k) for k in range(len(candidates)) if row[f"v{k}"] is not None and min_share <= row[f"s{k}"] <= max_share]
        if not fit or max(fit)[0] <= best:
            break
        best, k = max(fit)
        rules.append(candidates[k])
    return rules, best


def split_policy_value(scored: DataFrame, columns: list[str], id_column: str, **kwargs) -> dict:
    """Learn on one half, evaluate on the other, both ways; the halves are a hash of the id."""
    half = F.pmod(F.xxhash64(id_column), F.lit(2))
    values = []
    for k in (0, 1):
        rules, seen = learn_threshold_policy(scored.where(half == k), columns, **kwargs)
        out = policy_value(scored.where(half != k), any_rule([threshold_rule(*r) for r in rules])).first()
        values.append((out["value"], out["std_error"], seen))
    return {"value": sum(v[0] for v in values) / 2, "std_error": (values[0][1] ** 2 + values[1][1] ** 2) ** 0.5 / 2, "optimism": sum(v[2] - v[0] for v in values) / 2}


def policy_learner(scored: DataFrame, columns: list[str], id_column: str, **kwargs) -> dict:
    """Rules learned on all rows, their value there, the value on rows that did
    not learn them, and the difference of the two."""
    rules, _ = learn_threshold_policy(scored, columns, **kwargs)
    seen = policy_value(scored, any_rule([threshold_rule(*r) for r in rules])).first()
    split = split_policy_value(scored, columns, id_column, **kwargs)
    return {"rules": rules, "in_sample": seen["value"] or 0.0, "share": seen["share"], "value": split["value"], "std_error": split["std_error"], "optimism": (seen["value"] or 0.0) - split["value"]}


# ---- conformal intervals -----------------------------------------------------


def weighted_quantile(frame: DataFrame, keys: list[str], value: str, weight: str, level: float, chunks: int = 256) -> DataFrame:
    """Least value whose cumulative weight share reaches ``level``, by key: the
    values are summed in ranges, and only inside the range that crosses the level
    are they summed one by one."""
    cuts = frame.agg(F.percentile_approx(value, [(i + 1) / chunks for i in range(chunks - 1)], 20_000)).first()[0] or []
    per = _with_range(frame.groupBy(*keys, value).agg(F.sum(weight).alias("_w")), value, cuts, "_p")
    whole = Window.partitionBy(*keys)
    ranges = per.groupBy(*keys, "_p").agg(F.sum("_w").alias("_n"))  # at most ``chunks`` rows a key
    ranges = ranges.withColumn("_end", F.sum("_n").over(whole.orderBy("_p"))).withColumn("_need", F.sum("_n").over(whole) * (level - 1e-12))
    first = ranges.where("_end >= _need").groupBy(*keys).agg(F.min(F.struct("_p", F.expr("_end - _n").alias("_before"), "_need")).alias("_r")).select(*keys, "_r.*")
    inside = per.join(F.broadcast(first), [*keys, "_p"])
    run = inside.withColumn("_c", F.sum("_w").over(whole.orderBy(value)) + F.col("_before"))
    return run.where("_c >= _need").groupBy(*keys).agg(F.min(value).alias("quantile"))


def conformal_intervals(frame: DataFrame, *, y: str, d: str, mu1: str, mu0: str, propensity: str, calibrate: Column, alpha: float = 0.1) -> DataFrame:
    """Split-conformal intervals of individual effects.  Residuals of the
    calibration rows of each arm, weighted to the other arm, give one margin an arm."""
    odds = F.when(F.col(d) == 1, (1 - F.col(propensity)) / F.col(propensity)).otherwise(F.col(propensity) / (1 - F.col(propensity)))
    resid = F.abs(F.col(y) - F.when(F.col(d) == 1, F.col(mu1)).otherwise(F.col(mu0)))
    cal = frame.where(calibrate).select(F.col(d).alias("arm"), resid.alias("r"), odds.alias("w"))
    n = {r["arm"]: r["n"] for r in cal.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    margin = {}
    for arm in (0, 1):
        level = min(1.0, (1 - alpha) * (1 + 1 / max(n.get(arm, 0), 1)))
        row = weighted_quantile(cal.where(F.col("arm") == arm), ["arm"], "r", "w", level).first()
        margin[arm] = float(row["quantile"]) if row else float("inf")
    treated = F.col(d) == 1
    low = F.when(treated, F.col(y) - F.col(mu0) - margin[0]).otherwise(F.col(mu1) - margin[1] - F.col(y))
    high = F.when(treated, F.col(y) - F.col(mu0) + margin[0]).otherwise(F.col(mu1) + margin[1] - F.col(y))
    return frame.withColumn("effect_low", low).withColumn("effect_high", high)
