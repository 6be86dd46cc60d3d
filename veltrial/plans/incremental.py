"""A stored warehouse that is brought up to date by difference.

A manifest holds, for every day of every source, the number of rows and an
order-free digest of them.  A refresh compares it with the sources as they are,
finds the days of exposure that the changed days can reach, computes the users of
these days alone and overwrites their partitions; daily layers follow by the same
days, results are sums of daily rows.  The manifest is written last, so that a
refresh that broke off is done again from where it began.

Layers lie under ``target`` by day: users by day of exposure, daily layers by ds.
One refresh runs at a time; readers see each partition old or new.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltrial.plans import warehouse as layers
from veltrial.plans.warehouse import ARM

#: Daily layers that are sums over users, by day of exposure.
FROM_USERS = {"dws_experiment_variant_daily": layers.variant_daily, "dws_experiment_cluster_daily": layers.cluster_daily, "dws_experiment_ratio_daily": layers.ratio_daily, "dws_experiment_covariate_daily": layers.covariate_daily}


def day_digests(sources: dict[str, DataFrame]) -> DataFrame:
    """source, ds, rows, digest: a sum of row hashes, so the order of rows and files
    doesn't matter; sources without days are one day, NULL."""
    out = None
    for name, frame in sources.items():
        day = F.to_date("ts") if name == "exposure_log" else F.col("ds") if "ds" in frame.columns else F.lit(None).cast("date")
        one = frame.groupBy(day.alias("ds")).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(frame.columns)).cast("decimal(38,0)")).alias("digest"))
        one = one.select(F.lit(name).alias("source"), "ds", "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def changed_days(stored: DataFrame, now: DataFrame) -> DataFrame:
    """source, ds of days that are new, gone or different."""
    a, b = stored.alias("a"), now.alias("b")
    same = (F.col("a.source") == F.col("b.source")) & F.col("a.ds").eqNullSafe(F.col("b.ds"))
    differs = ~(F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.digest").eqNullSafe(F.col("b.digest")))
    return a.join(b, same, "full").where(differs).select(F.coalesce("a.source", "b.source").alias("source"), F.coalesce("a.ds", "b.ds").alias("ds"))


class StoredWarehouse:
    def __init__(self, spark: SparkSession, target: str, *, metric_event: str, pre_days: int = 14, post_days: int = 14):
        self.spark, self.target, self.metric_event, self.pre, self.post = spark, target.rstrip("/"), metric_event, pre_days, post_days

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/{name}")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _put(self, name: str, frame: DataFrame, by: str, days: list[date]) -> None:
        """Overwrite the partitions of ``days``; those that have no rows any more go."""
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.target}/{name}")
        left = {r[0] for r in self.table(name).where(F.col(by).isin(days)).select(by).distinct().collect()}
        has = {r[0] for r in frame.select(by).distinct().collect()}
        for day in left - has:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}/{by}={day}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _reached(self, changed: dict[str, list], first: DataFrame) -> list[date]:
        """Days of exposure whose users the changed days can touch."""
        days = {d + timedelta(days=k) for d in changed.get("event_log", []) for k in range(1 - self.post, self.pre + 1)}
        moved = changed.get("exposure_log", [])
        if moved:
            stored = self.table("dwd_experiment_user").select(*ARM, "user_id", "expose_ds") if self._exists("dwd_experiment_user") else None
            users = first.where(F.col("seen").isin(moved)).select(*ARM, "user_id").distinct()
            now = first.select(*ARM, "user_id", "expose_ds").distinct()
            if stored is not None:
                users = users.unionByName(stored.where(F.col("expose_ds").isin(moved)).select(*ARM, "user_id")).distinct()
                now = now.unionByName(stored)
            days |= {r[0] for r in now.join(users, [*ARM, "user_id"], "left_semi").select("expose_ds").distinct().collect()}
        return sorted(days)

    def refresh(self, sources: dict[str, DataFrame]) -> dict[str, list]:
        """Bring all layers up to date; returns the days written of each."""
        logs = {n: sources[n] for n in ("exposure_log", "event_log", "user_profile", "guardrail_config")}
        now = day_digests(logs).persist()
        try:
            if self._exists("manifest"):
                rows = changed_days(self.table("manifest"), now).collect()  # days of a calendar
            else:
                rows = now.select("source", "ds").collect()
            changed: dict[str, list] = {}
            for r in rows:
                changed.setdefault(r["source"], []).append(r["ds"])
            if "user_profile" in changed or not self._exists("dwd_experiment_user"):
                changed["exposure_log"] = [r[0] for r in now.where("source = 'exposure_log'").select("ds").collect()]
            written = self._write(sources, changed)
            now.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/manifest-next")
            self.spark.read.parquet(f"{self.target}/manifest-next").write.mode("overwrite").parquet(f"{self.target}/manifest")
        finally:
            now.unpersist()
        return written

    def _write(self, sources: dict[str, DataFrame], changed: dict[str, list]) -> dict[str, list]:
        written: dict[str, list] = {}
        log = sources["exposure_log"]
        seen = log.select(*ARM, "user_id", F.to_date("ts").alias("seen")).distinct()
        first = layers.first_exposures(log)
        days = self._reached(changed, first.join(seen, [*ARM, "user_id"]))
        if days:
            near = [min(days) - timedelta(days=self.pre), max(days) + timedelta(days=self.post)]
            events = sources["event_log"].where(F.col("ds").between(*near))
            again = first.where(F.col("expose_ds").isin(days)).withColumnRenamed("expose_ts", "ts")
            users = layers.experiment_users(again, events, sources["user_profile"], metric_event=self.metric_event, pre_days=self.pre, post_days=self.post)
            self._put("dwd_experiment_user", users, "expose_ds", days)
            stored = self.table("dwd_experiment_user").where(F.col("expose_ds").isin(days))
            for name, build in FROM_USERS.items():
                self._put(name, build(stored), "ds", days)
            written |= dict.fromkeys(["dwd_experiment_user", *FROM_USERS], days)
        # a guardrail's day is the event's: reached by its own events and by exposures up to post days before
        rails = set(changed.get("event_log", []))
        if "guardrail_config" in changed:
            rails |= {r[0] for r in sources["event_log"].select("ds").distinct().collect()}
        if "exposure_log" in changed:
            rails |= {d + timedelta(days=k) for d in days for k in range(self.post)}
        if rails:
            wanted = sorted(rails)
            daily = layers.guardrail_daily(log, sources["event_log"].where(F.col("ds").isin(wanted)), sources["guardrail_config"], post_days=self.post)
            self._put("dws_experiment_guardrail_daily", daily, "ds", wanted)
            written["dws_experiment_guardrail_daily"] = wanted
        self._results(sources)
        return written

    def _results(self, sources: dict[str, DataFrame]) -> None:
        """Roll-ups of daily rows: small, and written whole."""
        result = layers.result(self.table("dws_experiment_variant_daily"), sources["experiment_config"])
        made = {
            "ads_experiment_result": result, "ads_experiment_srm": layers.sample_ratio(result), "ads_experiment_ratio_result": layers.roll_up(self.table("dws_experiment_ratio_daily"), ARM),
            "ads_experiment_covariate_result": layers.covariate_result(self.table("dws_experiment_covariate_daily")), "ads_experiment_guardrail_result": layers.guardrail_result(self.table("dws_experiment_guardrail_daily")),
        }
        for name, frame in made.items():
            frame.write.mode("overwrite").parquet(f"{self.target}/{name}")
