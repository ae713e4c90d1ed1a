"""Per-window typology metrics and their summary per signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .windows import SIGNAL, arrays, spread

METRICS = ["hurst", "perm_entropy", "sample_entropy", "lyapunov_proxy", "spectral_flatness", "kurtosis", "cv", "range_norm", "zero_crossing_rate", "trend_strength", "mean_abs_diff"]


def metrics(y: np.ndarray) -> dict[str, float]:
    out = dict.fromkeys(METRICS, K.NAN)
    y = K.clean(y)
    if len(y) < 4:
        return out
    m, s = y.mean(), y.std()
    out.update(perm_entropy=K.permutation_entropy(y), sample_entropy=K.sample_entropy(y), kurtosis=K.shape(y)["kurtosis"], spectral_flatness=K.spectrum(y)["spectral_flatness"])
    if len(y) >= 20:
        out["hurst"] = K.rescaled_range(y)["hurst"]
    if len(y) >= 50:
        out["lyapunov_proxy"] = K.lyapunov_rosenstein(y, 3, 1)[0]
    if abs(m) > 1e-10:
        out["cv"], out["range_norm"] = s / abs(m), np.ptp(y) / abs(m)
    sign = np.where(np.abs(y - m) <= 1e-12 * np.abs(y).max(), 0, np.sign(y - m))  # equal but for the sum's rounding
    out["zero_crossing_rate"] = float((sign[1:] != sign[:-1]).mean())
    out["trend_strength"] = float(np.clip(K.line(np.arange(len(y), dtype=float), y)[2], 0, 1))
    out["mean_abs_diff"] = float(np.abs(np.diff(y)).mean())
    return out


def typology_windows(obs: DataFrame, window: int = 64, stride: int = 32) -> DataFrame:
    """A row for each window (short signals: one over all their rows)."""
    keys = [*SIGNAL, "window_id", "signal_0_start", "signal_0_end", "signal_0_center", "n_obs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([metrics(np.asarray(y, float)) for y in b["y"]], columns=METRICS, index=b.index, dtype=float)
            yield pd.concat([b[keys], made.replace([np.inf, -np.inf], np.nan)], axis=1)

    kinds = "cohort string, signal_id string, window_id long, signal_0_start double, signal_0_end double, signal_0_center double, n_obs long, " + ", ".join(f"{m} double" for m in METRICS)
    made = spread(arrays(obs, window, stride, short="one").select(*keys, "y")).mapInPandas(run, kinds)
    return made.select(*keys, *[F.nanvl(m, F.lit(None)).alias(m) for m in METRICS])


def summarise(windows: DataFrame, names: list[str] | None = None, varies_above: float = 0.1) -> DataFrame:
    """Mean, spread, coefficient of variation and whether it varies, of each metric."""
    names = names or [m for m in METRICS if m in windows.columns]
    aggs = [F.count("*").alias("n_windows")]
    for m in names:
        mean, std = F.avg(m), F.coalesce(F.stddev_samp(m), F.lit(0.0))
        cv = F.when(F.abs(mean) > 1e-10, std / F.abs(mean)).otherwise(std)
        aggs += [mean.alias(f"{m}_mean"), std.alias(f"{m}_std"), cv.alias(f"{m}_cv"), (cv > varies_above).alias(f"{m}_varies")]
    return windows.groupBy(*SIGNAL).agg(*aggs)
