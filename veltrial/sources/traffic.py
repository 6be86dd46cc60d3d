"""Readers, writers and contract checks for experiment traffic."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltrial.schemas import DIRECTIONS, REQUIRED_SOURCES, SOURCES


def read_source(spark: SparkSession, path: str, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Parquet or CSV; a CSV is read with the declared schema of ``name`` by its
    header's names, and a value that doesn't fit it fails the read."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
        if name is None:
            return raw
        typed = {f.name: f.dataType for f in SOURCES[name]}
        return raw.select(*[F.col(c).cast(typed[c]).alias(c) if c in typed else F.col(c) for c in raw.columns])
    raise ValueError(f"format {fmt!r}: parquet or csv expected")


def conform(frame: DataFrame, name: str) -> DataFrame:
    """The declared columns with the declared types; a missing one is null."""
    return frame.select(*[(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCES[name]])


def load_sources(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All source tables of a directory; an optional one that is absent is empty."""
    from pyspark.errors import AnalysisException

    out = {}
    for name, schema in SOURCES.items():
        try:
            out[name] = conform(read_source(spark, f"{directory}/{name}", name, fmt), name)
        except AnalysisException:
            if name in REQUIRED_SOURCES:
                raise
            out[name] = spark.createDataFrame([], schema)
    return out


def write_sources(sources: dict[str, DataFrame], directory: str) -> None:
    for name, frame in sources.items():
        conform(frame, name).write.mode("overwrite").parquet(f"{directory}/{name}")


@dataclass(frozen=True)
class DeclaredExperiment:
    """An external experiment: arms with weights, and guardrails, as declared."""

    name: str
    weights: dict[str, float]
    layer: str = "default"
    hypothesis: str | None = None
    guardrails: dict[str, tuple[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        if abs(sum(self.weights.values()) - 1) > 1e-6:
            raise ValueError(f"{self.name}: weights must sum to 1")
        for g, (direction, harm) in self.guardrails.items():
            if direction not in DIRECTIONS or harm < 0:
                raise ValueError(f"{self.name}: guardrail {g}")


def config_tables(spark: SparkSession, experiments: list[DeclaredExperiment]) -> tuple[DataFrame, DataFrame]:
    """experiment_config and guardrail_config; no true lift is NULL, never NaN."""
    arms = [(e.name, v, float(w), e.layer, None, e.hypothesis) for e in experiments for v, w in e.weights.items()]
    rails = [(e.name, g, d, float(h)) for e in experiments for g, (d, h) in e.guardrails.items()]
    return spark.createDataFrame(arms, SOURCES["experiment_config"]), spark.createDataFrame(rails, SOURCES["guardrail_config"])


def undeclared_arms(exposure_log: DataFrame, config: DataFrame) -> DataFrame:
    """Pairs of experiment and arm that no declaration knows, with their rows."""
    return exposure_log.join(F.broadcast(config.select("experiment", "variant")), ["experiment", "variant"], "left_anti").groupBy("experiment", "variant").agg(F.count("*").alias("rows"))


def undeclared_events(event_log: DataFrame, declared: list[str]) -> DataFrame:
    return event_log.where(~F.col("event_name").isin(declared) | F.col("event_name").isNull()).groupBy("event_name").agg(F.count("*").alias("rows"))


def users_without_exposure(event_log: DataFrame, exposure_log: DataFrame) -> DataFrame:
    return event_log.select("user_id").distinct().join(exposure_log.select("user_id").distinct(), "user_id", "left_anti")


def repeated_exposures(exposure_log: DataFrame) -> DataFrame:
    """Rows beyond the first of each experiment, arm and user."""
    return exposure_log.groupBy("experiment", "variant", "user_id").agg(F.count("*").alias("n")).groupBy("experiment").agg((F.sum("n") - F.count("*")).alias("repeats"))


def repeat_exposures(exposure_log: DataFrame, share: float = 0.1, minutes: int = 30) -> DataFrame:
    """The log and a share of its rows again, later: what a client that retries
    sends.  The rows are chosen by a hash, so a retried task chooses the same."""
    chosen = F.pmod(F.xxhash64("experiment", "variant", "user_id", "ts"), F.lit(10_000)) < int(share * 10_000)
    again = exposure_log.where(chosen).withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))).withColumn("ds", F.to_date("ts"))
    return exposure_log.unionByName(again)


def first_seen(event_log: DataFrame) -> DataFrame:
    """Events with the first day of their user."""
    return event_log.join(event_log.groupBy("user_id").agg(F.min("ds").alias("first_ds")), "user_id")


def users_of_both(event_log: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of users that another log knows too."""
    return event_log.join(other.select("user_id").distinct(), "user_id", "left_semi")


def split_by_median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds the exact median of each group, and whether a row is above it."""
    from veltrial.operators.ranks import exact_quantiles

    middle = exact_quantiles(rows, by, value).select(*by, F.col("quantile").alias("median"))
    return rows.join(middle, by).withColumn("above", F.col(value) > F.col("median"))


def declared_lifts(config: DataFrame) -> DataFrame:
    """Arms of each experiment, and those whose true lift is declared."""
    return config.groupBy("experiment").agg(F.count("*").alias("arms"), F.count("true_lift").alias("declared"))


def live_shares(users: DataFrame) -> DataFrame:
    """Share of users with anything measured after exposure: an arm at 0 has no data, not no effect."""
    live = F.when(F.col("post_metric") > 0, 1).otherwise(0)
    return users.groupBy("experiment", "variant").agg(F.count("*").alias("users"), F.sum(live).alias("live"), F.avg(live).alias("live_share"))


def list_experiments(exposure_log: DataFrame, config: DataFrame, guardrails: DataFrame) -> DataFrame:
    """Every experiment with its layer, arms, days and users; those with
    guardrails first, then the larger."""
    seen = exposure_log.groupBy("experiment").agg(F.countDistinct("variant").alias("arms"), F.countDistinct("user_id").alias("users"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    declared = config.groupBy("experiment").agg(F.any_value("layer").alias("layer"))  # one layer an experiment
    rails = guardrails.groupBy("experiment").agg(F.max(F.when(F.col("max_harm").isNotNull(), 1).otherwise(0)).alias("has_guardrails"))
    rows = seen.join(declared, "experiment", "left").join(rails, "experiment", "left")
    return rows.select("experiment", "layer", "arms", "users", "first_ds", "last_ds", F.coalesce("has_guardrails", F.lit(0)).alias("has_guardrails")).orderBy(F.desc("has_guardrails"), F.desc("users"), "experiment")


@dataclass
class IngestReport:
    rows: dict[str, int]
    dropped_columns: dict[str, list[str]]
    undeclared_events: dict[str, int]
    repeated_exposures: int
    users_without_exposure: int
    first_day: str | None
    last_day: str | None

    def to_dict(self) -> dict:
        return asdict(self)


def ingest(spark: SparkSession, raw: dict[str, DataFrame], experiments: list[DeclaredExperiment], target: str, *, metric_event: str, guardrail_events: tuple[str, ...] = ()) -> IngestReport:
    """Check external traffic against its declaration, store it in the layout
    that ``load_sources`` reads, and report what was found."""
    missing = {n: sorted({"user_id", "experiment", "variant", "ts"} - set(raw[n].columns)) if n == "exposure_log" else sorted({"ds", "user_id", "event_name", "metric_value"} - set(raw[n].columns)) for n in ("exposure_log", "event_log")}
    if any(missing.values()):
        raise ValueError(f"missing columns: {missing}")
    config, rails = config_tables(spark, experiments)
    exposure = raw["exposure_log"]
    if "ds" not in exposure.columns:
        exposure = exposure.withColumn("ds", F.to_date("ts"))
    frames = {"exposure_log": exposure, "event_log": raw["event_log"], "user_profile": raw.get("user_profile", spark.createDataFrame([], SOURCES["user_profile"])), "experiment_config": config, "guardrail_config": rails}
    frames = {n: conform(f, n) for n, f in frames.items()}
    unknown = undeclared_arms(frames["exposure_log"], config).limit(20).collect()
    if unknown:
        raise ValueError(f"undeclared arms: {[tuple(r) for r in unknown]}")
    write_sources(frames, target)
    stored = load_sources(spark, target)
    days = stored["event_log"].agg(F.min("ds"), F.max("ds")).first()
    return IngestReport(
        rows={n: f.count() for n, f in stored.items()},
        dropped_columns={n: [c for c in f.columns if c not in SOURCES[n].fieldNames()] for n, f in raw.items()},
        undeclared_events={r["event_name"]: r["rows"] for r in undeclared_events(stored["event_log"], [metric_event, *guardrail_events]).limit(100).collect()},
        repeated_exposures=repeated_exposures(stored["exposure_log"]).agg(F.sum("repeats")).first()[0] or 0,
        users_without_exposure=users_without_exposure(stored["event_log"], stored["exposure_log"]).count(),
        first_day=str(days[0]) if days[0] else None,
        last_day=str(days[1]) if days[1] else None,
    )


def fingerprint(config: object) -> str:
    """Stable short digest of a configuration, to tell whether stored data still fits it."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
