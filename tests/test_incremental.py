"""A refresh rewrites what changed, and equals a rebuild."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from veltrial.plans.incremental import StoredWarehouse
from veltrial.plans.warehouse import Warehouse
from veltrial.schemas import EXPERIMENT_CONFIG, GUARDRAIL_CONFIG

DAY = dt.datetime(2024, 5, 1, 10)


def sources(spark, exposures, events):
    expo = spark.createDataFrame(exposures, "experiment string, variant string, user_id string, ts timestamp")
    log = spark.createDataFrame(events, "ds date, user_id string, event_name string, metric_value double")
    users = sorted({e[2] for e in exposures})
    return {
        "exposure_log": expo, "event_log": log, "user_profile": spark.createDataFrame([(u, dt.date(2024, 1, 1), f"c{i % 3}") for i, u in enumerate(users)], "user_id string, reg_ds date, city string"),
        "experiment_config": spark.createDataFrame([("e", v, 0.5, "default", None, None) for v in ("control", "treatment")], EXPERIMENT_CONFIG), "guardrail_config": spark.createDataFrame([("e", "error", "lower_is_better", 0.05)], GUARDRAIL_CONFIG),
    }


def made():
    rng = np.random.default_rng(6)
    exposures = [("e", "control" if i % 2 else "treatment", f"u{i}", DAY + dt.timedelta(days=int(d))) for i in range(60) for d in (i % 20, 20 + i % 5)]
    events = [((DAY + dt.timedelta(days=int(d))).date(), f"u{i}", "error" if v > 45 else "purchase", float(v)) for i, d, v in zip(rng.integers(0, 65, 700), rng.integers(-5, 40, 700), rng.integers(1, 50, 700), strict=True)]
    return exposures, events


def rows(frame):
    columns = sorted(frame.columns)
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(cell(v) for v in r) for r in frame.select(columns).collect())


def files(target, name):
    return {p.parent.name: p.name for p in (target / name).glob("*=*/*.parquet")}


def equal_to_rebuild(spark, store, src):
    whole = Warehouse(src, "purchase", 3, 4)
    for name in Warehouse.TABLES:
        assert rows(store.table(name)) == rows(getattr(whole, name)), name


def test_refresh_by_difference(spark, tmp_path):
    exposures, events = made()
    store = StoredWarehouse(spark, str(tmp_path), metric_event="purchase", pre_days=3, post_days=4)
    src = sources(spark, exposures, events)
    store.refresh(src)
    equal_to_rebuild(spark, store, src)
    assert store.refresh(src) == {}  # nothing changed, nothing written

    # one more event on day 12: days of exposure 9 to 15 can see it
    events = events + [((DAY + dt.timedelta(days=12)).date(), "u12", "purchase", 500.0)]
    src = sources(spark, exposures, events[::-1])  # in another order
    before = {n: files(tmp_path, n) for n in ("dwd_experiment_user", "dws_experiment_variant_daily", "dws_experiment_guardrail_daily")}
    written = store.refresh(src)
    equal_to_rebuild(spark, store, src)
    days = {f"expose_ds={(DAY + dt.timedelta(days=d)).date()}" for d in range(9, 16)}
    after = files(tmp_path, "dwd_experiment_user")
    assert {d for d, f in after.items() if before["dwd_experiment_user"].get(d) != f} == days
    daily = files(tmp_path, "dws_experiment_variant_daily")
    assert {d for d, f in daily.items() if before["dws_experiment_variant_daily"].get(d) != f} == {d.replace("expose_ds", "ds") for d in days}
    assert written["dws_experiment_guardrail_daily"] == [(DAY + dt.timedelta(days=12)).date()]

    # a user's first exposure moves to an earlier day, and one day loses all its users
    gone = (DAY + dt.timedelta(days=7)).date()
    exposures = [e for e in exposures if e[3].date() != gone] + [("e", "treatment", "u18", DAY + dt.timedelta(days=2))]
    src = sources(spark, exposures, events)
    store.refresh(src)
    equal_to_rebuild(spark, store, src)
    assert not (tmp_path / f"dwd_experiment_user/expose_ds={gone}").exists()

    # a city changes: all users are made again
    src["user_profile"] = src["user_profile"].withColumn("city", F.lit("one"))
    store.refresh(src)
    equal_to_rebuild(spark, store, src)
