"""Structured Streaming forms: event-time windows, and count windows as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as K


def event_time_statistics(events: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Statistics of (cohort, signal_id) in sliding windows of event time; rows later than
    ``late`` are dropped, which bounds the state."""
    rows = events.withWatermark(time, late)
    v = F.col("value")
    made = rows.groupBy(F.window(time, window, slide), "cohort", "signal_id").agg(F.count("*").alias("n_points"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return made.select("cohort", "signal_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_points", "mean", "std", "min", "max")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    made = events.withWatermark(time, late).groupBy(F.session_window(time, gap), "cohort", "signal_id").agg(F.count("*").alias("n_points"), F.sum("value").alias("total"))
    return made.select("cohort", "signal_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_points", "total")


OUTPUT = "cohort string, signal_id string, window_id long, signal_0_start double, signal_0_end double, n_obs long, mean double, std double, kurtosis double, skewness double, rms double"


def count_windows(rows: DataFrame, window: int = 64, stride: int = 32) -> DataFrame:
    """Strided count windows over a stream: the state of a signal is its last ``window``
    rows and how many came before, whatever its length."""

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, s, y = state.get if state.exists else (0, [], [])
        s, y, out = list(s), list(y), []
        for b in batches:
            b = b.sort_values("signal_0", kind="stable")
            for a, v in zip(b["signal_0"], b["value"], strict=True):
                if v is None or not np.isfinite(v):
                    continue
                s.append(float(a))
                y.append(float(v))
                s, y, seen = s[-window:], y[-window:], seen + 1
                if seen >= window and (seen - window) % stride == 0:
                    own = np.array(y)
                    shape = K.shape(own)
                    out.append((key[0], key[1], (seen - window) // stride, s[0], s[-1], len(y), own.mean(), own.std(), shape["kurtosis"], shape["skewness"], float(np.sqrt((own**2).mean()))))
        state.update((seen, s, y))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return rows.groupBy("cohort", "signal_id").applyInPandasWithState(step, OUTPUT, "seen long, s array<double>, y array<double>", "append", GroupStateTimeout.NoTimeout)
