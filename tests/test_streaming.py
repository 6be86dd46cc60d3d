import datetime as dt

from pyspark.sql import functions as F

from veltrial.streaming import monitor


def drain(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name).collect()


def stream(spark, path, rows, schema, files=1):
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_daily_moments(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + d, h), "e", v, float(h), 1.0) for d in range(3) for h in (1, 5) for v in ("control", "treatment")]
    s = stream(spark, tmp_path / "o", rows, "ts timestamp, experiment string, variant string, post_metric double, pre_metric double")
    got = {(r["variant"], str(r["ds"])): (r["n"], r["sum_y"]) for r in drain(monitor.daily_moments(s), "daily", "update")}
    assert got["control", "2024-01-02"] == (2, 6.0) and len(got) == 6


def test_first_exposures_take_the_earliest(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("e", "a", "u1", t(1, 9)), ("e", "a", "u1", t(1, 3)), ("e", "a", "u2", t(1, 5)), ("e", "a", "late", t(9, 0)), ("e", "a", "later", t(20, 0)), ("e", "a", "last", t(28, 0))]
    s = stream(spark, tmp_path / "x", rows, "experiment string, variant string, user_id string, ts timestamp", files=6)
    got = {r["user_id"]: r["expose_ts"] for r in drain(monitor.first_exposures(s), "first", "append")}
    assert got["u2"] == t(1, 5) and got["u1"] in (t(1, 3), t(1, 9))


def test_request_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), "k") for s in (1, 30, 59)] + [(dt.datetime(2024, 1, 1, 0, 1, 1), "k")]
    s = stream(spark, tmp_path / "r", rows, "ts timestamp, key string")
    assert {r["n"] for r in drain(monitor.request_counts(s), "requests", "update")} == {3, 1}


def test_always_valid_state(spark, tmp_path):
    schema = "experiment string, variant string, look int, effect double, std_error double"
    rows = [("e", "a", k + 1, e, 1.0) for k, e in enumerate((0.5, 4.0, 1.0))]
    s = stream(spark, tmp_path / "l", rows + [("e", "null", k + 1, 0.1, 1.0) for k in range(3)], schema)
    every = sorted(drain(monitor.always_valid_monitor(s, tau=2.0), "valid", "append"), key=lambda r: r["look"])
    assert not any(r["rejected"] for r in every if r["variant"] == "null")
    got = [r for r in every if r["variant"] == "a"]
    p = [r["always_valid_p"] for r in got]
    assert p == sorted(p, reverse=True) and p[1] == p[2] and got[2]["rejected"]
    from veltrial.operators.sequential import always_valid_path

    batch = always_valid_path(spark.createDataFrame(rows, schema), 2.0).orderBy("look")
    assert [r[0] for r in batch.select(F.round("always_valid_p", 10)).collect()] == [round(x, 10) for x in p]


def test_a_first_exposure_comes_out_once(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d, 9)
    rows = [("e", "a", "u1", t(1)), ("e", "a", "x", t(5)), ("e", "a", "y", t(8)), ("e", "a", "u1", t(10)), ("e", "a", "z", t(20)), ("e", "a", "z2", t(25)), ("e", "a", "z3", t(28))]
    s = stream(spark, tmp_path / "once", rows, "experiment string, variant string, user_id string, ts timestamp", files=7)
    got = [(r["user_id"], r["expose_ts"]) for r in drain(monitor.first_exposures(s), "once", "append")]
    assert [x for x in got if x[0] == "u1"] == [("u1", t(1))] and len(got) == len({u for u, _ in got})


def test_late_events_restate_published_days(spark, tmp_path):
    """Events up to fourteen days late: the stored days equal the batch layer, and a
    batch that touches one day rewrites that day alone."""
    import numpy as np

    from veltrial.plans.warehouse import Warehouse, first_exposures
    from veltrial.streaming.restate import restate, store

    rng = np.random.default_rng(2)
    at = lambda day, h=12: dt.datetime(2024, 3, 1, h) + dt.timedelta(days=int(day))
    exposures = [("e", "control" if i % 2 else "treatment", f"u{i}", at(i % 10)) for i in range(40)]
    events = [(at(d), f"u{i}", "purchase" if i % 7 else "view", float(v)) for i, d, v in zip(rng.integers(0, 45, 400), rng.integers(-9, 25, 400), rng.integers(1, 50, 400), strict=True)]
    order = sorted(range(len(events)), key=lambda k: events[k][0] + dt.timedelta(days=int(rng.integers(0, 14))))
    events = [events[k] for k in order]
    first = stream(spark, tmp_path / "first", exposures, "experiment string, variant string, user_id string, expose_ts timestamp", files=2)
    log = stream(spark, tmp_path / "log", events, "ts timestamp, user_id string, event_name string, metric_value double", files=5)
    target = str(tmp_path / "stored")
    query = restate(first, log, target, metric_event="purchase", pre_days=7, post_days=10, delay="30 days", availableNow=True)
    query.awaitTermination()

    expo = spark.createDataFrame(exposures, "experiment string, variant string, user_id string, ts timestamp")
    days = spark.createDataFrame(events, "ts timestamp, user_id string, event_name string, metric_value double").withColumn("ds", F.to_date("ts"))
    profile = spark.createDataFrame([], "user_id string, city string, reg_ds date")
    batch = Warehouse({"exposure_log": expo, "event_log": days, "user_profile": profile}, "purchase", 7, 10).dws_experiment_variant_daily
    columns = sorted(batch.columns)
    read = lambda: spark.read.parquet(f"{target}/dws_experiment_variant_daily")
    rows = lambda f: sorted(tuple(str(v) for v in r) for r in f.select(columns).collect())
    assert rows(read()) == rows(batch) and first_exposures(expo).count() == 40

    files = lambda: {p.parent.name: p.name for p in (tmp_path / "stored/dws_experiment_variant_daily").glob("ds=*/*.parquet")}
    before = files()
    late = spark.createDataFrame([("e", "control", "u1", dt.date(2024, 3, 2), 0.0, 0, 5.0, 1)], "experiment string, variant string, user_id string, expose_ds date, pre_metric double, pre_cnt long, post_metric double, post_cnt long")
    assert store(late, 1000, target) == [dt.date(2024, 3, 2)]
    once = rows(read())
    assert {d for d, name in files().items() if before[d] != name} == {"ds=2024-03-02"} and once != rows(batch)
    store(late, 1000, target)  # a replay
    assert rows(read()) == once
