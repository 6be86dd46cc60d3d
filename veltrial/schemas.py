"""Table contracts: explicit schemas, and the keys that the quality checks use."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _D, _DT, _TS = T.StringType(), T.DoubleType(), T.DateType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


EXPOSURE_LOG = _schema(("ds", _DT), ("ts", _TS), ("user_id", _S), ("experiment", _S), ("variant", _S), ("layer", _S))
EVENT_LOG = _schema(("ds", _DT), ("user_id", _S), ("event_name", _S), ("metric_value", _D))
USER_PROFILE = _schema(("user_id", _S), ("reg_ds", _DT), ("city", _S))
EXPERIMENT_CONFIG = _schema(("experiment", _S), ("variant", _S), ("design_weight", _D), ("layer", _S), ("true_lift", _D), ("hypothesis", _S))
GUARDRAIL_CONFIG = _schema(("experiment", _S), ("guardrail", _S), ("direction", _S), ("max_harm", _D))

SOURCES = {"exposure_log": EXPOSURE_LOG, "event_log": EVENT_LOG, "user_profile": USER_PROFILE, "experiment_config": EXPERIMENT_CONFIG, "guardrail_config": GUARDRAIL_CONFIG}
#: Tables without which nothing can be built; the others default to empty ones.
REQUIRED_SOURCES = ("exposure_log", "event_log", "experiment_config")

DIRECTIONS = ("lower_is_better", "higher_is_better")


@dataclass(frozen=True)
class TableContract:
    """What a built table must satisfy."""

    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    non_negative: tuple[str, ...] = ()


_DAY = ("experiment", "variant", "ds")
_ARM = ("experiment", "variant")
CONTRACTS = {
    "dwd_experiment_user": TableContract(("experiment", "user_id"), ("variant", "expose_ds", "expose_ts"), non_negative=("pre_cnt", "post_cnt")),
    "dws_experiment_variant_daily": TableContract(_DAY, ("user_cnt",), non_negative=("user_cnt", "post_sq_sum", "pre_sq_sum")),
    "ads_experiment_result": TableContract(_ARM, ("user_cnt",), non_negative=("user_cnt", "post_sq_sum", "pre_sq_sum")),
    "ads_experiment_srm": TableContract(_ARM, ("user_cnt",), non_negative=("expected_cnt", "chi2_component")),
    "dws_experiment_cluster_daily": TableContract(("experiment", "variant", "cluster_id", "ds"), ("user_cnt",), non_negative=("user_cnt",)),
    "dws_experiment_ratio_daily": TableContract(_DAY, ("user_cnt",), non_negative=("sum_yy", "sum_xx")),
    "ads_experiment_ratio_result": TableContract(_ARM, ("user_cnt",), non_negative=("sum_yy", "sum_xx")),
    "dws_experiment_guardrail_daily": TableContract(("experiment", "variant", "ds", "guardrail"), ("user_cnt",), non_negative=("user_cnt", "value_sq_sum")),
    "ads_experiment_guardrail_result": TableContract(("experiment", "guardrail", "variant"), ("user_cnt",), non_negative=("user_cnt", "value_sq_sum")),
    "dws_experiment_covariate_daily": TableContract(_DAY, ("user_cnt",), non_negative=("pre_metric_sq_sum", "pre_cnt_sq_sum")),
    "ads_experiment_covariate_result": TableContract(_ARM, ("user_cnt",), non_negative=("pre_metric_sq_sum", "pre_cnt_sq_sum")),
    "guardrail_config": TableContract(("experiment", "guardrail"), ("direction", "max_harm"), enums={"direction": DIRECTIONS}, non_negative=("max_harm",)),
}
