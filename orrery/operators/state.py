"""Where a cohort stands: centroid, dispersion and trajectory views of its signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..schemas import available_groups

POINT = ["cohort", "window_id", "signal_0_start", "signal_0_end", "signal_0_center"]
HISTORY = 32


def _finite(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def usable_features(vector: DataFrame, features: list[str] | None = None) -> list[str]:
    groups = available_groups(vector.columns)
    return features or list(dict.fromkeys(f for own in groups.values() for f in own))


def centroid(vector: DataFrame, features: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Mean of each feature over a cohort's signals in a window, and the distances of the
    complete signals to it.  One exchange: the second aggregation has the keys of the
    window function before it."""
    own = usable_features(vector, features)
    w = Window.partitionBy("cohort", "window_id")
    rows = vector.select(*POINT, "signal_id", *([F.col(weight).cast("double").alias("__w")] if weight else [F.lit(1.0).alias("__w")]), *[_finite(f).alias(f) for f in own])
    rows = rows.where(F.coalesce(*own).isNotNull())
    mean = {f: F.try_divide(F.sum(F.col("__w") * F.col(f)).over(w), F.sum(F.when(F.col(f).isNotNull(), F.col("__w"))).over(w)) for f in own}
    rows = rows.withColumns({f"c_{f}": m for f, m in mean.items()})
    complete = F.lit(True)
    square = F.lit(0.0)
    for f in own:
        complete = complete & F.col(f).isNotNull()
        square = square + F.pow(F.coalesce(F.col(f) - F.col(f"c_{f}"), F.lit(0.0)), F.lit(2.0))
    rows = rows.withColumn("d", F.when(complete, F.sqrt(square)))
    several = F.count("d") >= 2
    return rows.groupBy("cohort", "window_id").agg(
        F.min("signal_0_start").alias("signal_0_start"), F.max("signal_0_end").alias("signal_0_end"), F.avg("signal_0_center").alias("signal_0_center"), F.count("*").alias("n_signals"),
        F.when(several, F.avg("d")).alias("mean_distance"), F.when(several, F.max("d")).alias("max_distance"), F.when(several, F.stddev_pop("d")).alias("std_distance"), *[F.first(f"c_{f}").alias(f"c_{f}") for f in own],
    )


def cohort_vector(vector: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Centroid and dispersion, the centroid named by feature group."""
    own = {g: f for g, f in (groups or available_groups(vector.columns)).items()}
    features = list(dict.fromkeys(f for fs in own.values() for f in fs))
    made = centroid(vector, features)
    return made.select(*POINT, "n_signals", "mean_distance", "max_distance", "std_distance", *[F.col(f"c_{f}").alias(f"state_{g}_{f}") for g, fs in own.items() for f in fs])


VIEWS = ("fourier_dominant_freq", "fourier_spectral_flatness", "envelope_mean", "envelope_trend", "envelope_cv", "wavelet_dominant_scale", "wavelet_scale_entropy", "wavelet_energy_ratio")


def _view(y: np.ndarray) -> list[float]:
    """Spectrum (8 points), envelope (4) and band energies (8) of one trajectory."""
    y = K.clean(y)
    out = [K.NAN] * len(VIEWS)
    if len(y) >= 4:
        env = np.abs(K.analytic(y))
        m = env.mean()
        out[2:5] = [float(m), K.line(np.arange(len(env), dtype=float), env)[0], float(env.std() / m) if m > 0 else K.NAN]
    if len(y) >= 8:
        s = K.spectrum(y)
        b = K.band_stability(y)
        out[0:2] = [s["dominant_freq"], s["spectral_flatness"]]
        out[5:8] = [b["wavelet_dominant_scale"], b["wavelet_entropy"], b["wavelet_concentration"]]
    return out


def trajectory_views(vector: DataFrame, features: list[str] | None = None, history: int = HISTORY) -> DataFrame:
    """Views of the last ``history`` windows of every signal's features, as medians over
    the cohort's signals.  A frame of ``history`` rows bounds what is read again."""
    own = usable_features(vector, features)
    past = Window.partitionBy("cohort", "signal_id").orderBy("window_id").rowsBetween(-(history - 1), 0)
    rows = vector.select("cohort", "signal_id", "window_id", *[F.collect_list(F.coalesce(_finite(f), F.lit(float("nan")))).over(past).alias(f) for f in own])
    names = [f"{view.split('_', 1)[0]}_{f}_{view.split('_', 1)[1]}" for f in own for view in VIEWS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [[v for f in own for v in _view(np.asarray(row[f], float))] for _, row in b[own].iterrows()]
            yield pd.concat([b[["cohort", "signal_id", "window_id"]], pd.DataFrame(made, columns=names, index=b.index, dtype=float)], axis=1)

    each = rows.mapInPandas(run, "cohort string, signal_id string, window_id long, " + ", ".join(f"`{n}` double" for n in names))
    return each.groupBy("cohort", "window_id").agg(*[F.percentile(F.nanvl(n, F.lit(None)), 0.5).alias(n) for n in names])


def laplacian_view(vector: DataFrame, features: list[str] | None = None, history: int = HISTORY) -> DataFrame:
    """Spectrum of the normalised Laplacian of the signals' absolute correlations.  The
    correlations are a join and an aggregation; only a cohort's matrix meets Python."""
    own = usable_features(vector, features)
    past = Window.partitionBy("cohort", "signal_id").orderBy("window_id").rowsBetween(-(history - 1), 0)
    rows = vector.select("cohort", "signal_id", "window_id", *[F.collect_list(F.coalesce(_finite(f), F.lit(0.0))).over(past).alias(f) for f in own])
    joined = rows.select("cohort", "window_id", "signal_id", F.concat(*own).alias("x"))

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("signal_id")
        longest = max(map(len, b["x"]))
        x = np.stack([np.pad(np.asarray(v, float), (0, longest - len(v))) for v in b["x"]])
        out = [K.NAN] * 4
        if len(x) >= 2:
            d = x - x.mean(1, keepdims=True)
            norm = np.sqrt((d * d).sum(1))
            a = np.abs(d @ d.T / np.maximum(np.outer(norm, norm), 1e-300)) * np.outer(norm > 1e-12, norm > 1e-12)
            np.fill_diagonal(a, 0)
            deg = a.sum(1)
            inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1e-300)), 0)
            e = np.linalg.eigvalsh(np.diag((deg > 0).astype(float)) - inv[:, None] * a * inv)
            out = [e[1], e[1] / e[-1] if e[-1] > 0 else K.NAN, float((e < 1e-10).sum()), e[-1]]
        return pd.DataFrame([[key[0], key[1], *out]], columns=["cohort", "window_id", "a", "b", "c", "d"])

    made = joined.groupBy("cohort", "window_id").applyInPandas(run, "cohort string, window_id long, a double, b double, c double, d double")
    return made.select("cohort", "window_id", *[F.nanvl(c, F.lit(None)).alias(n) for c, n in zip("abcd", ("laplacian_algebraic_connectivity", "laplacian_spectral_gap", "laplacian_n_components", "laplacian_max_eigenvalue"), strict=True)])
