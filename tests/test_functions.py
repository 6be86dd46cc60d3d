import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veltrial.functions import distributions as dist
from veltrial.functions import special
from veltrial.functions.hashing import murmur3_32, murmur3_strings
from veltrial.operators.assignment import Arm, Experiment, Layer, Slot, assign, distribution, route
from veltrial.operators.simulate import ramp_is_nested


def test_murmur_vectors():
    assert murmur3_strings(pd.Series(["", "hello"])).tolist() == [0, 613153351]
    one_by_one = [int(murmur3_strings(pd.Series([s]))[0]) for s in ("a", "ab", "abc", "日本", "u0000001")]
    assert murmur3_strings(pd.Series(["a", "ab", "abc", "日本", "u0000001"])).tolist() == one_by_one


def test_murmur_column_keeps_null(spark):
    df = spark.createDataFrame([("hello",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(murmur3_32("s")).collect()] == [613153351, None, 0]


def test_special_functions():
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_ppf(0.95, 3) == pytest.approx(7.814727903251179)
    assert special.f_sf(4.9646027437307145, 1, 10) == pytest.approx(0.05)
    assert special.t_sf(1.0, math.inf) == pytest.approx(special.normal_sf(1.0))
    assert special.ks_sf(1.3580986393225505 / (10 + 0.12 + 0.011), 100) == pytest.approx(0.05, abs=1e-3)


def test_distribution_columns(spark):
    df = spark.createDataFrame([(2.2281388519649385, 10.0), (None, 10.0)], "t double, df double")
    got = df.select(dist.t_two_sided(F.col("t"), F.col("df"))).collect()
    assert got[0][0] == pytest.approx(0.05) and got[1][0] is None


def test_assignment(spark):
    units = spark.range(4000).select(F.format_string("u%07d", "id").alias("user_id"))
    exp = Experiment("e", (Arm("control", 0.3), Arm("b", 0.3), Arm("treatment", 0.4)), traffic_ratio=0.5)
    counts = {r["variant"]: r["units"] for r in distribution(assign(units, exp), exp).collect()}
    assert sum(counts.values()) == 4000
    assert abs(counts["__not_enrolled__"] - 2000) < 150 and abs(counts["treatment"] - 800) < 120
    assert exp.probabilities() == {"control": 0.3, "b": 0.3, "treatment": 0.4}
    steps = ramp_is_nested(units, exp, (0.05, 0.25, 1.0)).collect()
    assert all(r["left"] == 0 and r["changed"] == 0 for r in steps) and steps[-1]["enrolled"] == 4000


def test_declarations_are_checked():
    with pytest.raises(ValueError):
        Experiment("e", (Arm("a", 0.5), Arm("b", 0.4)))
    with pytest.raises(ValueError):
        Layer("l", (Slot("a", 0, 6000), Slot("b", 5000, 7000)))
    assert Layer("l", (Slot("a", 0, 2500),)).coverage() == 0.25
    with pytest.raises(KeyError):
        Layer("l", (Slot("a", 0, 2500),)).slot_of("b")


def test_routing_uses_every_bucket_once(spark):
    layer = Layer("l", (Slot("a", 0, 5000), Slot("b", 5000, 10000)))
    units = spark.range(2000).select(F.col("id").cast("string").alias("user_id"))
    got = {r["experiment"]: r["count"] for r in route(units, layer).groupBy("experiment").count().collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] - 1000) < 120


def test_hash_is_uniform():
    h = murmur3_strings(pd.Series([f"salt:group:{i}" for i in range(20000)])) % 100
    chi2 = ((np.bincount(h, minlength=100) - 200) ** 2 / 200).sum()
    assert special.chi2_sf(chi2, 99) > 1e-3
