"""Quality gates of stored tables: keys, nulls, enums, signs, and agreement of layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.plans.warehouse import Warehouse
from veltrial.schemas import CONTRACTS, TableContract

REL_TOL = 1e-9


def check_table(frame: DataFrame, contract: TableContract, name: str = "") -> DataFrame:
    """(table, check, bad): one row a check.  Keys are counted by grouping, so a
    key that half the rows share is summed up before it is shuffled, and a null
    in a key counts as a value."""
    null = lambda c: F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0))
    aggs = [null(c).alias(f"null_key:{c}") for c in contract.key] + [null(c).alias(f"null:{c}") for c in contract.required]
    aggs += [F.coalesce(F.sum((F.col(c).isNull() | ~F.col(c).isin(*values)).cast("long")), F.lit(0)).alias(f"enum:{c}") for c, values in contract.enums.items()]
    aggs += [F.coalesce(F.sum((F.col(c) < 0).cast("long")), F.lit(0)).alias(f"negative:{c}") for c in contract.non_negative]
    wide = frame.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("bad")) for c in wide.columns])).alias("r")).select("r.check", "r.bad")
    repeats = frame.groupBy(*contract.key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad")).select(F.lit("duplicate_key").alias("check"), "bad")
    return long.unionByName(repeats).select(F.lit(name).alias("table"), "check", F.col("bad").cast("long").alias("bad"))


def arm_switchers(users: DataFrame) -> DataFrame:
    """Users whom one experiment showed several arms."""
    return users.groupBy("experiment", "user_id").agg(F.countDistinct("variant").alias("arms")).where("arms > 1")


def cross_layer(warehouse: Warehouse) -> DataFrame:
    """(check, experiment, variant, detail, summary, ok): users against results."""
    detail = warehouse.dwd_experiment_user.groupBy("experiment", "variant").agg(
        F.count("user_id").cast("double").alias("user_cnt"), F.sum("post_metric").alias("post_sum"), F.sum("pre_metric").alias("pre_sum"), F.sum(F.col("pre_metric") * F.col("post_metric")).alias("pre_post_cross_sum")
    )
    measures = ["user_cnt", "post_sum", "pre_sum", "pre_post_cross_sum"]
    pair = lambda f, n: f.select("experiment", "variant", F.explode(F.array(*[F.struct(F.lit(m).alias("check"), F.col(m).cast("double").alias(n)) for m in measures])).alias("r")).select("experiment", "variant", "r.*")
    both = pair(detail, "detail").join(pair(warehouse.ads_experiment_result, "summary"), ["experiment", "variant", "check"], "full")
    near = F.abs(F.col("detail") - F.col("summary")) <= REL_TOL * F.greatest(F.abs("detail"), F.abs("summary"), F.lit(1.0))
    return both.select("check", "experiment", "variant", "detail", "summary", F.coalesce(near, F.lit(False)).alias("ok"))


def check_quality(warehouse: Warehouse) -> DataFrame:
    """All table checks of a warehouse; bad > 0 is a finding."""
    tables = warehouse.tables() | {"guardrail_config": warehouse.sources["guardrail_config"]}
    return reduce(DataFrame.unionByName, [check_table(frame, CONTRACTS[name], name) for name, frame in tables.items()])


def check_lineage(lineage: dict[str, tuple[str, ...]], order: tuple[str, ...], sources: tuple[str, ...]) -> list[str]:
    """Tables built before what they need, or from something unknown."""
    known, bad = set(sources), []
    for name in order:
        bad += [f"{name} needs {x}" for x in lineage[name] if x not in known]
        known.add(name)
    return bad


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, schema): what a build stored, to compare with later."""
    return reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(f.schema.simpleString()).alias("schema")) for n, f in tables.items()])


def check_manifest(stored: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Tables that are gone, new, or changed since the manifest."""
    now = manifest(tables).select("table", F.col("rows").alias("rows_now"), F.col("schema").alias("schema_now"))
    return stored.join(now, "table", "full").where(~(F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("schema").eqNullSafe(F.col("schema_now"))))
