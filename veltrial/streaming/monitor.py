"""The warehouse's daily sums and the always-valid rule on streams.

Alpha-spending plans need their final information in advance, so a stream of
unknown length gets the always-valid rule alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veltrial.operators.inference import moments


def daily_moments(outcomes: DataFrame, *, delay: str = "2 days", y: str = "post_metric", x: str | None = "pre_metric") -> DataFrame:
    """outcomes(ts, experiment, variant, y, x): sums per experiment, arm and day;
    a day is final once the watermark has passed it."""
    w = outcomes.withWatermark("ts", delay).groupBy("experiment", "variant", F.window("ts", "1 day"))
    return w.agg(*moments(y, x)).select("experiment", "variant", F.to_date("window.start").alias("ds"), "n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")


def first_exposures(exposures: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per experiment, arm and user: the earliest timestamp among those
    that come until the watermark passes, in any order of arrival.

    The state of a user stays, as a mark, after the row has come out: an exposure
    that comes later, however much, is never a first one again."""

    def earliest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, _ = state.get
            state.update((ts, True))
            yield pd.DataFrame([[*key, pd.Timestamp(ts, unit="us")]], columns=["experiment", "variant", "user_id", "expose_ts"])
            return
        seen, done = state.get if state.exists else (None, False)
        if done:
            return
        least = min([int(b["ts"].min().value // 1000) for b in batches if len(b)] + ([seen] if seen is not None else []))
        state.update((least, False))
        state.setTimeoutTimestamp(max(least // 1000, state.getCurrentWatermarkMs()) + 1)

    keyed = exposures.select("experiment", "variant", "user_id", "ts").withWatermark("ts", delay).groupBy("experiment", "variant", "user_id")
    return keyed.applyInPandasWithState(earliest, "experiment string, variant string, user_id string, expose_ts timestamp", "least long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def request_counts(requests: DataFrame, window: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """requests(ts, key): counts per key and tumbling window."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", window), "key").agg(F.count("*").alias("n")).select("key", F.col("window.start").alias("start"), "n")


def always_valid_monitor(looks: DataFrame, tau: float, alpha: float = 0.05) -> DataFrame:
    """looks(experiment, variant, look, effect, std_error) as they come: the running
    least p-value of each arm, kept as state of one number."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("look", kind="stable")
        effect, v = rows["effect"].to_numpy(float), rows["std_error"].to_numpy(float) ** 2
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            ratio = np.sqrt(v / (v + tau**2)) * np.exp(effect**2 * tau**2 / (2 * v * (v + tau**2)))
            p = np.where(ratio > 1, 1 / ratio, 1.0)
        best = np.minimum.accumulate(np.minimum(np.nan_to_num(p, nan=1.0), state.get[0] if state.exists else 1.0))
        state.update((float(best[-1]),))
        yield pd.DataFrame({"experiment": key[0], "variant": key[1], "look": rows["look"].to_numpy(), "always_valid_p": best, "rejected": best <= alpha})

    return looks.groupBy("experiment", "variant").applyInPandasWithState(update, "experiment string, variant string, look int, always_valid_p double, rejected boolean", "best double", "append", GroupStateTimeout.NoTimeout)
