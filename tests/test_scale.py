"""Operators that must not gather a key, an arm or a table in one place."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veltrial.operators import clusters, compare, forest, inference, looks, sequential, simulate, splits
from veltrial.operators.assignment import assign_salts, orthogonality, salt_pairs
from veltrial.operators.ranks import exact_quantiles, hashed_ranks, quantiles_by_key


@pytest.mark.parametrize("accuracy", [50, 10_000])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.73, 1.0])
def test_exact_quantiles(spark, q, accuracy):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"k": rng.integers(0, 4, 3000), "v": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000).round(2))})
    frame.loc[frame.k == 3, "v"] = 1.0  # one value
    df = spark.createDataFrame([(int(k), float(v)) for k, v in frame.values] + [(0, None), (9, 2.5)], "k int, v double").repartition(5)
    got = {r["k"]: (r["n"], r["quantile"]) for r in exact_quantiles(df, ["k"], "v", q, accuracy).collect()}
    want = frame.groupby("k")["v"].quantile(q)
    assert {k: v for k, (_, v) in got.items() if k != 9} == pytest.approx(want.to_dict()) and got[9] == (1, 2.5)


@pytest.mark.parametrize("few_keys", [None, True, False])
def test_a_keys_quantiles_need_no_task_of_its_own(spark, few_keys):
    rng = np.random.default_rng(12)
    frame = pd.DataFrame({"k": (rng.random(4000) < 0.02).astype(int), "v": np.where(rng.random(4000) < 0.2, 1.5, rng.normal(size=4000))})
    df = spark.createDataFrame([(int(k), float(v)) for k, v in frame.values], "k int, v double").repartition(5)
    got = quantiles_by_key(df, ["k"], "v", [0.1, 0.5, 0.501, 0.9], 50, few_keys)
    want = frame.groupby("k")["v"].quantile([0.1, 0.5, 0.501, 0.9])
    assert {(r["k"], r["q"]): r["quantile"] for r in got.collect()} == pytest.approx(want.to_dict())
    joins = [line for line in plan_of(got).splitlines() if "SortMergeJoin" in line]
    assert len(joins) == (few_keys is False) and all("_slice" in line for line in joins)


def test_hashed_ranks_and_prefixes(spark):
    rows = spark.range(5000).select(F.lit("e").alias("experiment"), F.when(F.col("id") % 3 == 0, "control").otherwise("treatment").alias("variant"), F.col("id").cast("string").alias("user_id"), F.col("id").cast("double").alias("post_metric"), F.lit(1.0).alias("pre_metric"))
    order = F.shiftrightunsigned(F.xxhash64("user_id"), 32)
    got = hashed_ranks(rows, ["variant"], order, "user_id", ranges=64).toPandas()
    for _, arm in got.groupby("variant"):
        assert sorted(arm["rank"]) == list(range(1, len(arm) + 1)) and set(arm["total"]) == {len(arm)}
    tied = hashed_ranks(rows, ["variant"], F.lit(5), "user_id").toPandas().sort_values("rank")
    assert tied[tied.variant == "control"]["user_id"].tolist() == sorted(tied[tied.variant == "control"]["user_id"])
    cells = {(r["variant"], r["look"]): r["n"] for r in looks.nested_prefixes(rows, 4).collect()}
    assert [cells["control", k] for k in (1, 2, 3, 4)] == [417, 834, 1251, 1667]  # as ntile: the first shares are the larger ones


def test_bounds_follow_each_arms_information(spark):
    rows = [("a", "t", k + 1, i, 2.3, 1.0) for k, i in enumerate((0.9037, 1.0))] + [("b", "t", k + 1, i, 2.5, 1.0) for k, i in enumerate((0.2, 0.4, 0.6, 0.8, 1.0))] + [("c", "t", 1, 0.5, 1.0, 1.0), ("c", "t", 2, 0.5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "experiment string, variant string, look int, info double, effect double, std_error double")
    got = {(r["experiment"], r["look"]): r for r in sequential.monitor(df).collect()}
    assert got["a", 1]["boundary"] == pytest.approx(sequential.boundaries((0.9037, 1.0))[0]) and got["a", 1]["crossed"]
    assert got["b", 1]["boundary"] == pytest.approx(4.3826, abs=2e-4) and not got["b", 3]["crossed"] and got["b", 5]["crossed"]
    assert got["c", 2]["boundary"] is None and not got["c", 2]["stopped"]  # information that doesn't rise has no bound
    interim = sequential.spending_bounds((0.2, 0.4))
    assert interim == pytest.approx(sequential.boundaries((0.2, 0.4, 0.6, 0.8, 1.0))[:2])  # what comes later doesn't matter
    assert sum(sequential.exit_probabilities((0.9037, 1.0), sequential.boundaries((0.9037, 1.0)))) == pytest.approx(0.05, abs=1e-8)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_splits_are_summed_before_they_are_exchanged(spark):
    users = spark.range(300).select(F.col("id").cast("string").alias("user_id"), F.lit("e").alias("experiment"), F.lit("x").alias("variant"), F.rand(1).alias("pre_metric"), F.rand(2).alias("post_metric"), F.lit(1).alias("post_cnt"))
    salts = spark.createDataFrame([(f"s{i}",) for i in range(5)], "salt string")
    text = plan_of(simulate.resplit(users, salts).groupBy("experiment", "variant").agg(F.sum("post_metric")))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
    assert assign_salts(users, salts).count() == 1500


def test_injected_lift_is_found_and_covered(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", "e", "x", f"2024-01-{1 + i % 10:02d}", float(x), float(x + rng.normal(scale=2) + 10), 2) for i, x in enumerate(rng.normal(5, 2, 800))]
    users = spark.createDataFrame(rows, "user_id string, experiment string, variant string, expose_ds string, pre_metric double, post_metric double, post_cnt long").withColumn("expose_ds", F.to_date("expose_ds"))
    salts = spark.createDataFrame([(f"s{i}",) for i in range(40)], "salt string")
    null = {(r["test"], r["look"]): r for r in simulate.look_calibration(users, salts).collect()}
    lifted = {(r["test"], r["look"]): r for r in simulate.look_calibration(users, salts, lift=0.05).collect()}
    assert null["adjusted", 5]["rejected"] <= 0.2 <= 0.9 <= lifted["adjusted", 5]["rejected"]
    assert lifted["plain", 5]["rejected"] <= lifted["adjusted", 5]["rejected"] and lifted["adjusted", 5]["stopped"] >= 0.9
    assert all(r["covered"] >= 0.8 for r in [*null.values(), *lifted.values()]) and lifted["ratio", 5]["rejected"] > null["ratio", 5]["rejected"]


def test_wild_bootstrap_by_hashed_weights(spark):
    rng = np.random.default_rng(4)
    data = [("e", "control" if g < 12 else "treatment", f"g{g}", float(n), float(n * (10 + rng.normal() + (8 if g >= 12 else 0))), 0.0, 0.0) for g, n in enumerate(rng.integers(5, 40, 24))]
    totals = spark.createDataFrame(data, "experiment string, variant string, cluster_id string, n double, sum_y double, sum_x double, sum_yy double")
    strong = clusters.wild_cluster_bootstrap(totals, n_bootstrap=399).first()
    robust = clusters.cluster_robust(totals).first()
    assert strong["p_value"] <= 0.01 and strong["effect"] == pytest.approx(robust["effect"]) and strong["std_error"] == pytest.approx(robust["std_error"])
    same = clusters.wild_cluster_bootstrap(totals.repartition(7), n_bootstrap=399).first()
    assert same["p_value"] == strong["p_value"]  # no draw depends on where a row is
    flat = totals.withColumn("sum_y", F.col("n") * (10 + F.col("n") % 3))
    assert clusters.wild_cluster_bootstrap(flat, n_bootstrap=399, imposed=False).first()["p_value"] > 0.01


def test_kolmogorov_distance(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=700), np.where(rng.random(900) < 0.3, 0.5, rng.normal(0.2, 1, 900))
    points = np.concatenate((a, b))
    gaps = np.abs(np.searchsorted(np.sort(a), points, "right") / 700 - np.searchsorted(np.sort(b), points, "right") / 900)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = compare.kolmogorov_distance(frame(a), frame(b), "v", ranges=32).first()
    assert (got["n_left"], got["n_right"]) == (700, 900) and got["distance"] == pytest.approx(gaps.max()) and got["at"] == pytest.approx(min(points[np.isclose(gaps, gaps.max())]))
    assert got["p_value"] < 0.05 and compare.kolmogorov_distance(frame(a), frame(a), "v").first()["p_value"] == 1.0


def test_orthogonal_and_equal_salts(spark):
    units = spark.range(4000).select(F.col("id").cast("string").alias("user_id"))
    got = {(r["left_salt"], r["right_salt"]): r for r in orthogonality(salt_pairs(units, ["a", "b", "a"])).collect()}
    assert got["a", "b"]["p_value"] > 0.001 and got["a", "a"]["chi2"] == pytest.approx(4000)
    over = simulate.share_dispersion(units, spark.createDataFrame([(f"s{i}",) for i in range(30)], "salt string")).first()
    assert over["splits"] == 30 and over["over_p"] > 0.001 and over["under_p"] > 0.001


def trial(spark, n=6000):
    rng = np.random.default_rng(11)
    x, z, d = rng.random(n), rng.random(n), rng.integers(0, 2, n)
    y = 2 * z + d * np.where(x > 0.5, 3.0, 0.0) + rng.normal(size=n)
    return spark.createDataFrame([(i, float(a), float(b), float(t), float(v)) for i, (a, b, t, v) in enumerate(zip(x, z, d, y, strict=True))], "id long, x double, z double, d double, y double").repartition(4)


def test_forest_finds_the_effect(spark):
    rows = trial(spark)
    edges = forest.quantile_edges(rows, ["x", "z"], bins=16)
    grown = forest.grow(rows, forest.Plan(("x", "z"), edges, bags=6, bag_trees=3, depth=2, min_leaf=40), y="y", d="d", id_column="id")
    first = [s for (_, node), s in grown.splits.items() if node == 1]
    assert len(first) == 18 and all(f == 0 and abs(edges[0][b] - 0.5) < 0.1 for f, b, _ in first)
    assert grown.importance()["x"] > 0.9
    got = forest.predict(rows, grown).toPandas()
    low, high = got[got.x < 0.4], got[got.x > 0.6]
    assert abs(low.cate.mean()) < 0.3 and abs(high.cate.mean() - 3) < 0.3 and (got.cate_se < 1).all()


def test_forest_without_rows_or_arms(spark):
    rows = trial(spark, 60).where("d = 1")
    grown = forest.grow(rows, forest.Plan(("x",), ((0.5,),), bags=2, bag_trees=2), y="y", d="d", id_column="id")
    assert not grown.splits and forest.predict(rows, grown).where("NOT isnan(cate)").count() == 0
    empty = forest.grow(rows.limit(0), forest.Plan(("x",), ((0.5,),), bags=2, bag_trees=2), y="y", d="d", id_column="id")
    assert not empty.splits


def test_groups_and_slope_over_splits(spark):
    rows = trial(spark)
    judged = splits.judged(rows, y="y", d="d", features=["x", "z"], id_column="id", propensity=0.5, n_splits=6).persist()
    blp = splits.best_linear_predictor(judged)
    slope = splits.over_splits(blp, [], "slope", "slope_se").first()
    mean = splits.over_splits(blp, [], "effect", "effect_se").first()
    assert slope["splits"] == 6 and slope["low"] < 1.2 and slope["low"] > 0.5 and mean["low"] < 1.5 < mean["high"]
    groups = {r["group"]: r["estimate"] for r in splits.over_splits(splits.sorted_groups(judged, 4), ["group"], "effect", "std_error").collect()}
    assert sorted(groups) == [1, 2, 3, 4] and groups[1] < 0.6 and groups[4] > 2.4
    judged.unpersist()


def test_splits_judge_rows_where_they_are(spark):
    judged = splits.judged(trial(spark, 400), y="y", d="d", features=["x"], id_column="id", propensity=0.5, n_splits=3)
    for rows in (splits.best_linear_predictor(judged), splits.sorted_groups(judged)):
        text = plan_of(rows)
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    by_md5 = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("5"), F.lit(3), F.col("id"))), 1, 8), 16, 10).cast("long") % 2
    assert spark.range(500).where(splits.half(F.lit(3), F.col("id"), 5) != by_md5).count() == 0


def test_look_sums_stay_in_few_tasks(spark):
    users = spark.range(400).select(F.col("id").cast("string").alias("user_id"), F.lit("e").alias("experiment"), F.lit("x").alias("variant"), F.expr("date_add(date'2024-01-01', CAST(id % 9 AS INT))").alias("expose_ds"), F.rand(1).alias("pre_metric"), F.rand(2).alias("post_metric"), F.lit(1).alias("post_cnt"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        arms = simulate.replicate_looks(users.repartition(9), spark.createDataFrame([(f"s{i}",) for i in range(6)], "salt string"))
        assert arms.rdd.getNumPartitions() <= simulate.FEW_TASKS
        assert arms.count() == 6 * 2 * 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_forest_draws_without_numbers(spark):
    plan = forest.Plan(("x",), ((0.5,),), bags=2, bag_trees=2)
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("0"), *parts)), 1, 8), 16, 10).cast("long") % 2
    rows = spark.range(300).select("id", F.lit(1.0).alias("y"), F.lit(1.0).alias("d"), F.lit(0.1).alias("x"))
    want = [F.when(number(F.lit("bag"), F.lit(t // 2), F.col("id")) == 1, 2).otherwise(number(F.lit("tree"), F.lit(t), F.col("id")).cast("int")) for t in range(4)]
    got = forest.prepared(rows.withColumn("y", F.col("id").cast("double")), plan, y="y", d="d", id_column="id")
    assert "conv(" not in plan_of(got)  # a draw's parity is that of one digit
    both = got.join(rows.select(F.col("id").cast("double").alias("_y"), F.array(*want).alias("want")), "_y")
    assert both.count() == 300 and both.where("_role != want").count() == 0


def test_looks_read_their_users_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return str(i), "e", "x", date(2024, 1, 1 + i % 9), float(i % 7), float(i % 5), 1

    kinds = "user_id string, experiment string, variant string, expose_ds date, pre_metric double, post_metric double, post_cnt int"
    users = spark.createDataFrame(spark.sparkContext.parallelize(range(300), 3).map(seen), kinds)
    assert simulate.replicate_looks(users, spark.createDataFrame([(f"s{i}",) for i in range(4)], "salt string")).count() == 4 * 2 * 5
    assert read.value == 300


def test_all_tests_share_one_python_step(spark):
    sums = [(f"s{i}", v, 50 + i, 90.0 + i, 100.0 + 3 * i * (v == "treatment"), 260.0, 300.0, 200.0) for i in range(6) for v in ("control", "treatment")]
    names = ("sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")
    arms = spark.createDataFrame(sums, ["experiment", "variant", "n", *names]).withColumns({f"ratio_{c}": F.col(c) for c in names})
    rows = simulate._estimates(arms, 0.05).where("p_value IS NOT NULL")
    assert plan_of(rows).count("ArrowEvalPython") == 1 and rows.rdd.getNumPartitions() <= simulate.FEW_TASKS
    got = {(r["test"], r["experiment"]): r for r in rows.collect()}
    pairs, columns = inference.contrasts(arms.select("experiment", "variant", "n", *names)), ("effect", "std_error", "t_statistic", "p_value", "ci_low", "ci_high")
    assert len(got) == 18
    for name, one in (("plain", inference.welch(pairs)), ("adjusted", inference.cuped(pairs)), ("ratio", inference.ratio_delta(pairs))):
        for r in inference.with_test(one.select("experiment", "effect", "std_error", "df")).collect():
            assert [got[name, r["experiment"]][c] for c in columns] == pytest.approx([r[c] for c in columns])
