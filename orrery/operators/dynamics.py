"""How cohorts move: derivatives of geometry, thermodynamics, velocity fields,
finite-time Lyapunov exponents, ridge proximity, stability and topology."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kernels as K
from .windows import SIGNAL, arrays, spread

FLOOR = 1e-12


# ---- derivatives ---------------------------------------------------------------------


def gradient(y: Column | str, s: str, w: WindowSpec) -> Column:
    """Second-order gradient on an uneven axis, first-order at the ends."""
    y = F.col(y) if isinstance(y, str) else y
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    hs = F.greatest(F.col(s) - F.lag(s).over(w), F.lit(FLOOR))
    hd = F.greatest(F.lead(s).over(w) - F.col(s), F.lit(FLOOR))
    inner = (hs * hs * after + (hd * hd - hs * hs) * y - hd * hd * before) / (hs * hd * (hs + hd))
    return F.when(before.isNull() & after.isNull(), F.lit(None).cast("double")).when(before.isNull(), (after - y) / hd).when(after.isNull(), (y - before) / hs).otherwise(inner)


def smooth(y: str, w: WindowSpec, edge: str = "zero") -> Column:
    """Mean of three; beyond the ends lie zeros, or nothing (``shrink``)."""
    near = F.coalesce(F.lag(y).over(w), F.lit(0.0)) + F.col(y) + F.coalesce(F.lead(y).over(w), F.lit(0.0))
    n = F.lit(3.0) if edge == "zero" else 1.0 + F.lag(y).over(w).isNotNull().cast("double") + F.lead(y).over(w).isNotNull().cast("double")
    return near / n


def geometry_dynamics(geometry: DataFrame, threshold: float = -0.05, least_run: int = 3, edge: str = "zero") -> DataFrame:
    """Velocity, acceleration, jerk and curvature of effective dimension, velocities of the
    first eigenvalue and the variance, and the longest run of collapsing dimension."""
    by = Window.partitionBy("cohort", "engine").orderBy("signal_0_end")
    rows = geometry.select("cohort", "engine", "signal_0_end", "effective_dim", "eigenvalue_1", "total_variance").where("effective_dim is not null")
    rows = rows.withColumns({"n": F.count("*").over(Window.partitionBy("cohort", "engine")), "t": F.row_number().over(by) - 1}).where("n >= 3")
    rows = rows.withColumns({f"z_{c}": F.when(F.col("n") > 3, smooth(c, by, edge)).otherwise(F.col(c)) for c in ("effective_dim", "eigenvalue_1", "total_variance")})
    rows = rows.withColumns({"effective_dim_velocity": gradient("z_effective_dim", "signal_0_end", by), "eigenvalue_1_velocity": gradient("z_eigenvalue_1", "signal_0_end", by), "variance_velocity": gradient("z_total_variance", "signal_0_end", by)})
    rows = rows.withColumn("effective_dim_acceleration", gradient("effective_dim_velocity", "signal_0_end", by))
    rows = rows.withColumn("effective_dim_jerk", gradient("effective_dim_acceleration", "signal_0_end", by))
    v = F.col("effective_dim_velocity")
    rows = rows.withColumn("effective_dim_curvature", F.abs("effective_dim_acceleration") / F.pow(1 + v * v, F.lit(1.5)))
    # collapse: steps count, not the axis; runs are islands of falling rows
    rows = rows.withColumn("falls", (F.col("z_effective_dim") - F.lag("z_effective_dim").over(by)) < threshold)
    rows = rows.withColumn("island", F.sum(F.when(F.coalesce(F.col("falls"), F.lit(False)), 0).otherwise(1)).over(by))
    runs = rows.where("falls").groupBy("cohort", "engine", "island").agg(F.count("*").alias("k"), F.min("t").alias("start"))
    longest = runs.where(F.col("k") >= least_run).groupBy("cohort", "engine").agg(F.max_by("start", F.struct("k", -F.col("start"))).alias("onset"))
    out = rows.join(longest, ["cohort", "engine"], "left")
    onset = F.coalesce(F.col("onset"), F.lit(-1))
    return out.select(
        "cohort", "engine", "signal_0_end", "effective_dim", "effective_dim_velocity", "effective_dim_acceleration", "effective_dim_jerk", "effective_dim_curvature", "eigenvalue_1", "eigenvalue_1_velocity", "total_variance", "variance_velocity",
        onset.cast("long").alias("collapse_onset_idx"), F.when(onset >= 0, onset / F.col("n")).alias("collapse_onset_fraction"),
    )


def phase_points(rows: DataFrame, value: str, dim: int = 3, delay: int = 1, keys: tuple[str, ...] = ("cohort", "engine"), order: str = "signal_0_end") -> DataFrame:
    """Delay embedding of a column: x_0 is the value, x_i the one i ``delay`` rows later."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.select(*keys, order, *[F.lead(value, i * delay).over(w).alias(f"x_{i}") if i else F.col(value).alias("x_0") for i in range(dim)]).where(F.col(f"x_{dim - 1}").isNotNull())


def thermodynamics(geometry: DataFrame) -> DataFrame:
    """Entropy of the mean spectrum, energy (mean effective dimension), temperature (variance
    of its rate) and free energy, by cohort and engine, so that engines do not mix."""
    by = Window.partitionBy("cohort", "engine").orderBy("signal_0_end")
    step = F.col("signal_0_end") - F.lag("signal_0_end").over(by)
    rate = (F.col("effective_dim") - F.lag("effective_dim").over(by)) / F.greatest(step, F.lit(FLOOR))
    vals = [f"eigenvalue_{i}" for i in range(1, 6)]
    total = sum((F.col(v) for v in vals), F.lit(0.0))
    share = [F.try_divide(F.col(v), F.nullif(total, F.lit(0.0))) for v in vals]
    entropy = sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in share), F.lit(0.0))
    rows = geometry.withColumns({"h": entropy, "r": rate})
    made = rows.groupBy("cohort", "engine").agg(F.avg("h").alias("entropy"), F.avg("effective_dim").alias("energy"), F.stddev_pop("effective_dim").alias("energy_std"), F.var_pop("r").alias("temperature"), F.count("*").alias("n_samples"))
    return made.withColumn("free_energy", F.col("energy") - F.coalesce(F.col("temperature"), F.lit(0.0)) * F.col("entropy"))


# ---- velocity fields -----------------------------------------------------------------


def _savgol_taps(window: int = 11, degree: int = 3) -> list[float]:
    x = np.arange(window) - window // 2
    return [float(v) for v in np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0]]


def savgol(y: str, w: WindowSpec, window: int = 11, degree: int = 3) -> Column:
    """Savitzky-Golay smoothing as a dot of neighbours; rows nearer to an end than half a
    window stay as they are."""
    taps, half = _savgol_taps(window, degree), window // 2
    terms = [F.lit(t) * (F.col(y) if k == half else (F.lag(y, half - k) if k < half else F.lead(y, k - half)).over(w)) for k, t in enumerate(taps)]
    made = sum(terms[1:], terms[0])
    return F.coalesce(made, F.col(y))


def velocity_components(obs: DataFrame, standardise: bool = True, smoothing: bool = False) -> DataFrame:
    """(cohort, signal_id, signal_0, velocity, acceleration) of every signal: differences
    over the axis, standing at the later point."""
    own, w = Window.partitionBy(*SIGNAL), Window.partitionBy(*SIGNAL).orderBy("signal_0")
    # dealt by signal once: equal points and all windows below stay in their partition
    rows = obs.where("value is not null and not isnan(value)").repartition(*SIGNAL).groupBy(*SIGNAL, "signal_0").agg(F.avg("value").alias("x"))
    if standardise:
        m, s = F.avg("x").over(own), F.stddev_pop("x").over(own)
        rows = rows.withColumn("x", F.when(s > 1e-10, (F.col("x") - m) / s).otherwise(0.0))
    if smoothing:
        rows = rows.withColumn("x", savgol("x", w))
    dt = F.greatest(F.col("signal_0") - F.lag("signal_0").over(w), F.lit(FLOOR))
    rows = rows.withColumns({"velocity": (F.col("x") - F.lag("x").over(w)) / dt, "dt": dt})
    mid = (F.col("dt") + F.lag("dt").over(w)) / 2
    return rows.withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / mid).where("velocity is not null").select(*SIGNAL, "signal_0", "velocity", "acceleration")


def velocity_field(components: DataFrame, keys: tuple[str, str] = ("cohort", "signal_0"), name: str = "signal_id") -> DataFrame:
    """Speed, acceleration along and across the motion, curvature, the signal that moves
    most, and the number of directions the motion spreads over.  All are sums over a
    point's components."""
    v, a = F.col("velocity"), F.coalesce(F.col("acceleration"), F.lit(0.0))
    made = components.groupBy(*keys).agg(
        F.sum(v * v).alias("vv"), F.sum(a * a).alias("aa"), F.sum(v * a).alias("va"), F.count_if(F.col("acceleration").isNotNull()).alias("na"),
        F.max_by(name, F.struct(F.abs(v), F.col(name))).alias("dominant_motion_signal"), F.max(v * v).alias("top"), F.max_by(name, F.struct(F.abs(a), F.col(name))).alias("dominant_accel_signal"),
        F.sum(F.when(v != 0, v * v * F.ln(v * v)).otherwise(0.0)).alias("vlv"),
    )
    speed = F.sqrt("vv")
    along = F.try_divide(F.col("va"), F.nullif(speed, F.lit(0.0)))
    across = F.sqrt(F.greatest(F.col("aa") - F.coalesce(along * along, F.lit(0.0)), F.lit(0.0)))
    has = F.col("na") > 0
    # entropy of the squared direction: ln(sum) - sum(v2 ln v2) / sum
    spread = F.when(F.col("vv") > 0, F.exp(F.ln("vv") - F.col("vlv") / F.col("vv")))
    return made.select(
        *keys, speed.alias("speed"), F.when(has, F.sqrt("aa")).alias("acceleration_magnitude"), F.when(has, along).alias("acceleration_parallel"), F.when(has, across).alias("acceleration_perpendicular"),
        F.when(has, across / (F.col("vv") + 1e-12)).alias("curvature"), "dominant_motion_signal", F.when(F.col("vv") > 0, F.col("top") / F.col("vv")).alias("dominant_motion_fraction"), "dominant_accel_signal", spread.alias("motion_dimensionality"),
    )


# ---- Lyapunov exponents --------------------------------------------------------------


def stability_class(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < -0.1, "strongly_stable").when(x < -0.01, "stable").when(x <= 0.01, "marginal").when(x <= 0.1, "unstable").otherwise("chaotic")


def _exponent(y: np.ndarray, delay: int | None = None, dim: int | None = None) -> tuple[float, float, int, int, float]:
    delay = delay or K.optimal_delay(y)
    dim = dim or K.cao_dimension(y, delay)
    value, div = K.lyapunov_rosenstein(y, dim, delay)
    good = div[np.isfinite(div)]
    return value, float(good.std()) if len(good) else K.NAN, dim, delay, min(1.0, len(good) / 50)


def _last(obs: DataFrame, most: int | None, keys: list[str], reverse: bool = False) -> DataFrame:
    """(keys, s, y): the last ``most`` rows of each series, which bounds what is gathered;
    None: all of them."""
    rows = obs.where("value is not null and not isnan(value)")
    if most is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc("signal_0"), F.desc("value"))
        rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    made = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("signal_0").alias("s"), F.col("value").alias("y")))).alias("x"))
    y = F.transform("x", lambda p: p["y"])
    return spread(made.select(*keys, F.transform("x", lambda p: p["s"]).alias("s"), (F.reverse(y) if reverse else y).alias("y")))


def ftle(obs: DataFrame, direction: str = "forward", intervention: float | None = None, least: int = 200, most: int = 2000, keys: list[str] = SIGNAL) -> DataFrame:
    """Largest exponent of each series by Rosenstein's method; backward: of the reversed
    series.  With an intervention also before and after it; the part before, short by
    nature, needs 50 rows at most."""
    parts = {"": obs} if intervention is None else {"": obs, "_pre": obs.where(F.col("signal_0") < intervention), "_post": obs.where(F.col("signal_0") >= intervention)}

    def run(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                y = np.asarray(r["y"], float)
                value, spread, dim, delay, sure = _exponent(y) if len(y) >= least else (K.NAN, K.NAN, 0, 0, 0.0)
                rows.append([*[r[k] for k in keys], value, spread, dim, delay, sure, len(y)])
            yield pd.DataFrame(rows, columns=[*keys, "ftle", "ftle_std", "embedding_dim", "embedding_tau", "confidence", "n_samples"])

    schema = ", ".join(f"{k} string" for k in keys) + ", ftle double, ftle_std double, embedding_dim int, embedding_tau int, confidence double, n_samples long"
    needs = {"": least, "_pre": min(least, 50), "_post": least}
    made = {s: _last(o, most, keys, direction == "backward").mapInPandas(partial(run, least=needs[s]), schema) for s, o in parts.items()}
    out = made[""].withColumn("direction", F.lit(direction))
    out = out.withColumns({"ftle": F.nanvl("ftle", F.lit(None)), "ftle_std": F.nanvl("ftle_std", F.lit(None))}).withColumn("stability", stability_class(F.col("ftle")))
    for suffix in ("_pre", "_post"):
        if suffix in made:
            out = out.join(made[suffix].select(*keys, F.nanvl("ftle", F.lit(None)).alias(f"ftle{suffix}"), F.col("n_samples").alias(f"n{suffix}")), keys, "left")
    return out if intervention is None else out.withColumn("ftle_delta", F.col("ftle_post") - F.col("ftle_pre"))


def ftle_bidirectional(obs: DataFrame, **options) -> DataFrame:
    return ftle(obs, "forward", **options).unionByName(ftle(obs, "backward", **options))


def lyapunov(obs: DataFrame, dim: int = 3, least: int = 200, most: int = 2000, method: str = "rosenstein") -> DataFrame:
    """The same exponent at a fixed embedding dimension; ``method``: of the nearest neighbour
    (``rosenstein``) or of all near ones (``kantz``)."""
    follow = {"rosenstein": K.lyapunov_rosenstein, "kantz": K.lyapunov_kantz}[method]

    def of(y: np.ndarray) -> tuple[float, int, float]:
        delay = K.optimal_delay(y)
        value, div = follow(y, dim, delay)
        return value, delay, min(1.0, float(np.isfinite(div).sum()) / 50)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, s, y in zip(b["cohort"], b["signal_id"], b["y"], strict=True):
                y = np.asarray(y, float)
                value, delay, sure = of(y) if len(y) >= least else (K.NAN, 0, 0.0)
                rows.append([c, s, value, dim, delay, sure, len(y)])
            yield pd.DataFrame(rows, columns=[*SIGNAL, "lyapunov", "embedding_dim", "embedding_tau", "confidence", "n_samples"])

    made = _last(obs, most, SIGNAL).mapInPandas(run, "cohort string, signal_id string, lyapunov double, embedding_dim int, embedding_tau int, confidence double, n_samples long")
    return made.withColumn("lyapunov", F.nanvl("lyapunov", F.lit(None)))


def lyapunov_rolling(obs: DataFrame, window: int = 500, stride: int = 50, dim: int = 3) -> DataFrame:
    """The exponent at a fixed dimension of strided windows, each at its own delay."""

    @F.pandas_udf("lyapunov double, confidence double")
    def exponent(y: pd.Series) -> pd.DataFrame:
        made = [_exponent(np.asarray(v, float), None, dim) for v in y]
        return pd.DataFrame([(m[0], m[4]) for m in made], columns=["lyapunov", "confidence"])

    made = spread(arrays(obs, window, stride)).withColumn("e", exponent("y"))
    return made.select(*SIGNAL, "window_id", "signal_0_end", F.nanvl("e.lyapunov", F.lit(None)).alias("lyapunov"), "e.confidence")


def ftle_rolling(obs: DataFrame, window: int = 200, stride: int = 50) -> DataFrame:
    """Exponents of strided windows, with the embedding of the signal's first window, their
    steps and the steps' steps."""
    rows = arrays(obs, window, stride)
    first = rows.where("window_id = 0").select(*SIGNAL, F.col("y").alias("y0"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y0 = [np.asarray(y, float) for y in b["y0"]]
            delay = [K.optimal_delay(y) for y in y0]
            dim = [K.cao_dimension(y, d) for y, d in zip(y0, delay, strict=True)]
            yield b[SIGNAL].assign(embedding_dim=dim, embedding_tau=delay).astype({"embedding_dim": "int32", "embedding_tau": "int32"})

    settled = first.mapInPandas(settle, "cohort string, signal_id string, embedding_dim int, embedding_tau int")

    @F.pandas_udf("ftle double, ftle_std double, confidence double")
    def exponent(y: pd.Series, dim: pd.Series, delay: pd.Series) -> pd.DataFrame:
        made = [_exponent(np.asarray(a, float), int(t), int(d)) for a, d, t in zip(y, dim, delay, strict=True)]
        return pd.DataFrame([(m[0], m[1], m[4]) for m in made], columns=["ftle", "ftle_std", "confidence"])

    made = rows.join(settled, SIGNAL).withColumn("e", exponent("y", "embedding_dim", "embedding_tau"))
    w = Window.partitionBy(*SIGNAL).orderBy("window_id")
    made = made.select(*SIGNAL, "window_id", "signal_0_start", "signal_0_end", "signal_0_center", F.nanvl("e.ftle", F.lit(None)).alias("ftle"), F.nanvl("e.ftle_std", F.lit(None)).alias("ftle_std"), "e.confidence", "embedding_dim", "embedding_tau")
    made = made.withColumn("ftle_velocity", F.coalesce(F.col("ftle") - F.lag("ftle").over(w), F.lit(0.0)))
    inner = F.lag("window_id").over(w).isNotNull() & F.lead("window_id").over(w).isNotNull()
    return made.withColumn("ftle_acceleration", F.when(inner, F.col("ftle_velocity") - F.lag("ftle_velocity").over(w)).otherwise(0.0))


def exponent_trend(rolling: DataFrame, value: str = "ftle") -> DataFrame:
    """Line through a signal's rolling exponents: is it losing stability?"""
    x = F.col("window_id").cast("double")
    return rolling.where(F.col(value).isNotNull()).groupBy(*SIGNAL).agg(F.count("*").alias("n_windows"), F.regr_slope(value, x).alias(f"{value}_trend"), F.when(F.var_pop(value) > 1e-15, F.regr_r2(value, x)).otherwise(0.0).alias(f"{value}_trend_r2"), F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_spread"))


def ridge_proximity(rolling: DataFrame, field: DataFrame, ridge: float = 0.05) -> DataFrame:
    """Rolling exponents met by the cohort's speed at the same point: how fast the state
    runs up the exponent's slope, and how long to the ridge."""
    w = Window.partitionBy(*SIGNAL).orderBy("signal_0_end")
    rows = rolling.where("ftle is not null").join(field.select("cohort", F.col("signal_0").alias("signal_0_end"), "speed"), ["cohort", "signal_0_end"])
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*SIGNAL))).where("n >= 3")
    rows = rows.withColumn("ftle_gradient", gradient("ftle", "signal_0_end", w))
    rows = rows.withColumn("ftle_curve", gradient("ftle_gradient", "signal_0_end", w)).withColumn("urgency", F.col("speed") * F.col("ftle_gradient"))
    close = (F.col("urgency") > 0.001) & (F.abs("ftle_gradient") > 1e-6)
    time = F.when(close, F.greatest(F.lit(0.0), ridge - F.col("ftle")) / (F.abs("urgency") + 1e-12)).otherwise(F.lit(float("inf")))
    kind = F.when(close & (F.col("time_to_ridge") < 10), "critical").when(close & (F.col("time_to_ridge") < 50), "elevated").when(F.col("urgency") > 0, "warning").otherwise("nominal")
    return rows.withColumn("time_to_ridge", time).select("cohort", "signal_id", "signal_0_start", "signal_0_end", "signal_0_center", F.col("ftle").alias("ftle_current"), "ftle_gradient", F.col("ftle_curve").alias("ftle_acceleration"), "speed", "urgency", "time_to_ridge", kind.alias("urgency_class"))


# ---- stability and topology ----------------------------------------------------------

_STABILITY = {
    "h_freq_stability_mean": ("inst_freq_stability", "avg"), "h_freq_stability_min": ("inst_freq_stability", "min"), "h_freq_std_max": ("inst_freq_std", "max"), "h_freq_drift_mean": ("inst_freq_drift", "avg"), "h_freq_drift_spread": ("inst_freq_drift", "std"),
    "h_amp_cv_mean": ("inst_amp_cv", "avg"), "h_amp_trend_mean": ("inst_amp_trend", "avg"), "h_phase_coherence_mean": ("hilbert_phase_coherence", "avg"), "h_phase_coherence_min": ("hilbert_phase_coherence", "min"), "h_am_fm_ratio_mean": ("am_fm_ratio", "avg"),
    "w_entropy_mean": ("wavelet_entropy", "avg"), "w_concentration_mean": ("wavelet_concentration", "avg"), "w_energy_drift_mean": ("wavelet_energy_drift", "avg"), "w_energy_drift_max": ("wavelet_energy_drift", "max"), "w_temporal_std_mean": ("wavelet_energy_std", "avg"),
    "w_intermittency_mean": ("wavelet_energy_kurtosis", "avg"), "w_intermittency_max": ("wavelet_energy_kurtosis", "max"),
    "w_energy_low_mean": ("energy_low", "avg"), "w_energy_high_mean": ("energy_high", "avg"), "w_energy_ratio_mean": ("energy_ratio", "avg"),
}
_INPUTS = sorted({c for c, _ in _STABILITY.values()})


def _stability(y: np.ndarray) -> dict[str, float]:
    y = K.clean(y)
    out = K.hilbert(y) | K.band_stability(y) | {"energy_low": K.NAN, "energy_high": K.NAN, "energy_ratio": K.NAN}
    if len(y) >= 10:
        p = np.abs(np.fft.rfft(y - y.mean())) ** 2
        e = [x.sum() for x in np.array_split(p[1:], 3)]
        if sum(e) > 1e-15:
            out.update(energy_low=e[0] / sum(e), energy_high=e[2] / sum(e), energy_ratio=e[0] / e[2] if e[2] > 1e-15 else K.NAN)
    return {k: out[k] for k in _INPUTS}


def signal_stability(obs: DataFrame, window: int = 30, stride: int = 5) -> DataFrame:
    """Twenty summaries over a cohort's signals of their windows' phase and band energies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([_stability(np.asarray(y, float)) for y in b["y"]], columns=_INPUTS, index=b.index, dtype=float)
            yield pd.concat([b[["cohort", "window_id", "signal_0_start", "signal_0_end", "signal_0_center"]], made.replace([np.inf, -np.inf], np.nan)], axis=1)

    schema = "cohort string, window_id long, signal_0_start double, signal_0_end double, signal_0_center double, " + ", ".join(f"{c} double" for c in _INPUTS)
    rows = arrays(obs, window, stride, short="one").select("cohort", "window_id", "signal_0_start", "signal_0_end", "signal_0_center", "y").mapInPandas(run, schema)
    rows = rows.withColumns({c: F.nanvl(c, F.lit(None)) for c in _INPUTS})
    fn = {"avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}
    return rows.groupBy("cohort", "window_id").agg(
        F.min("signal_0_start").alias("signal_0_start"), F.max("signal_0_end").alias("signal_0_end"), F.avg("signal_0_center").alias("signal_0_center"), F.count("*").alias("n_signals"),
        F.count("inst_freq_std").alias("n_hilbert_signals"), F.count("wavelet_entropy").alias("n_wavelet_signals"), *[fn[k](c).alias(name) for name, (c, k) in _STABILITY.items()],
    )


def _persistence(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(H0 deaths, H1 (birth, death)) of the Vietoris-Rips filtration of a few points:
    H0 by the spanning tree, H1 by reduction of the triangles' boundaries."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, d[i, j]))
    i, j, length = i[order], j[order], d[i, j][order]
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    deaths, loops = [], set()
    for e, (a, b) in enumerate(zip(i, j, strict=True)):
        ra, rb = find(int(a)), find(int(b))
        if ra != rb:
            parent[ra] = rb
            deaths.append(length[e])
        else:
            loops.add(e)
    number = {(int(a), int(b)): e for e, (a, b) in enumerate(zip(i, j, strict=True))}
    triangles = sorted((max(number[a, b], number[b, c], number[a, c]), a, b, c) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n))
    low: dict[int, frozenset] = {}
    bars = []
    for last, a, b, c in triangles:
        column = {number[a, b], number[b, c], number[a, c]}
        while column and (top := max(column)) in low:
            column ^= low[top]
        if column:
            top = max(column)
            low[top] = frozenset(column)
            if length[last] > length[top]:
                bars.append((length[top], length[last]))
            loops.discard(top)
        if not loops:
            break
    return np.array(deaths), np.array(bars).reshape(-1, 2)


def persistence_summary(x: np.ndarray) -> dict[str, float]:
    """Betti numbers above the median lifetime, entropies, longest and total lifetimes."""
    deaths, bars = _persistence(x)
    out = {"n_points": float(len(x))}
    for k, life in ((0, deaths), (1, bars[:, 1] - bars[:, 0])):
        life = life[life > 1e-12]
        p = life / life.sum() if len(life) else life
        noise = np.median(life) if len(life) else 0.0
        out |= {f"betti_{k}": float((life > noise).sum() + (k == 0)), f"persistence_entropy_{k}": float(-(p * np.log(p)).sum() / np.log(len(p))) if len(p) > 1 else 0.0, f"max_persistence_{k}": float(life.max()) if len(life) else 0.0, f"total_persistence_{k}": float(life.sum()), f"n_significant_{k}": float((life > 2 * noise).sum())}
    return out


TOPOLOGY = list(persistence_summary(np.zeros((3, 2)) + np.arange(3)[:, None]))


def persistent_homology(cohort_vector: DataFrame, window: int = 20, stride: int = 5) -> DataFrame:
    """Topology of 20-row windows of the standardised state trajectory."""
    own = [c for c, k in cohort_vector.dtypes if c.startswith("state_") and k == "double"]
    per = Window.partitionBy("cohort")
    order = Window.partitionBy("cohort").orderBy("window_id")
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(per), F.nullif(F.stddev_pop(c).over(per), F.lit(0.0))), F.lit(0.0)) for c in own}
    frame = order.rowsBetween(-(window - 1), 0)
    rows = cohort_vector.select("cohort", "window_id", "signal_0_start", "signal_0_end", F.array(*z.values()).alias("x"), (F.row_number().over(order) - 1).alias("i"))
    rows = rows.withColumns({"cloud": F.collect_list("x").over(frame), "signal_0_start": F.first("signal_0_start").over(frame)}).where((F.col("i") >= window - 1) & ((F.col("i") - (window - 1)) % stride == 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([persistence_summary(np.stack([np.asarray(p, float) for p in c])) for c in b["cloud"]], columns=TOPOLOGY, index=b.index, dtype=float)
            yield pd.concat([b[["cohort", "window_id", "signal_0_start", "signal_0_end"]], made], axis=1)

    return rows.select("cohort", "window_id", "signal_0_start", "signal_0_end", "cloud").mapInPandas(run, "cohort string, window_id long, signal_0_start double, signal_0_end double, " + ", ".join(f"{c} double" for c in TOPOLOGY))


# ---- critical slowing down -----------------------------------------------------------


def kendall_trend(rows: DataFrame, value: str, order: str = "window_id") -> DataFrame:
    """Kendall's tau of a column against the order of a signal's windows, with the normal
    approximation's p.  A signal's windows (one number each) are gathered, and their pairs
    counted by merging."""
    known = rows.where(F.col(value).isNotNull())
    made = known.groupBy(*SIGNAL).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(value).alias("x")))), lambda p: p["x"]).alias("y"))

    @F.pandas_udf("up long, down long")
    def count(y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.concordance(np.asarray(v, float)) for v in y], columns=["up", "down"])

    made = spread(made).withColumn("c", count("y")).select(*SIGNAL, F.size("y").cast("double").alias("n"), (F.col("c.up") - F.col("c.down")).alias("s"), (F.col("c.up") + F.col("c.down")).alias("m")).where("n > 1")
    n = F.col("n")
    z = F.abs("s") / F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    # a logistic approximation of the normal tail, within 2e-4
    tail = 2 / (1 + F.exp(1.5976 * z + 0.070566 * F.pow(z, F.lit(3.0))))
    return made.select(*SIGNAL, F.try_divide(F.col("s"), F.nullif(F.col("m"), F.lit(0))).alias(f"tau_{value}"), tail.alias(f"tau_{value}_pvalue"))


def critical_slowing_down(obs: DataFrame, window: int = 50, stride: int = 10) -> DataFrame:
    """Rising autocorrelation, variance and skewness of detrended windows, and a score."""
    from ..functions import columns as C

    n = F.count("value").over(Window.partitionBy(*SIGNAL))
    order = Window.partitionBy(*SIGNAL).orderBy("signal_0", "value")
    rows = obs.where("value is not null and not isnan(value)").withColumns({"i": (F.row_number().over(order) - 1).cast("double"), "n": n})
    whole = Window.partitionBy(*SIGNAL)
    slope = F.coalesce(F.regr_slope("value", "i").over(whole), F.lit(0.0))
    flat = rows.withColumn("value", F.col("value") - F.avg("value").over(whole) - slope * (F.col("i") - F.avg("i").over(whole))).select(*SIGNAL, "signal_0", "value")
    w = arrays(flat, window, stride)
    y = F.col("y")
    m = C.array_mean(y)
    var = C.var_samp_array(y)
    third = F.aggregate(y, F.lit(0.0), lambda a, v: a + F.pow(v - m, F.lit(3.0))) / F.size(y)
    made = w.select(*SIGNAL, "window_id", C.acf(y, 1).alias("ac1"), var.alias("var"), F.when(var > 1e-15, third / F.pow(var, F.lit(1.5))).alias("skew"))
    t = F.col("window_id").cast("double")
    last = lambda c: F.max_by(c, F.col("window_id"))
    out = made.groupBy(*SIGNAL).agg(
        F.count("*").alias("n_windows"), last("ac1").alias("autocorrelation_lag1"), last("var").alias("variance"), last("skew").alias("skewness"),
        F.regr_slope("ac1", t).alias("autocorr_trend"), F.regr_r2("ac1", t).alias("autocorr_trend_r2"), F.regr_slope("var", t).alias("variance_trend"), F.regr_r2("var", t).alias("variance_trend_r2"), F.min_by("var", F.col("window_id")).alias("var0"),
    )
    ac = F.col("autocorrelation_lag1")
    part = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    score = 0.3 * part(ac) + 0.25 * part(F.when(F.col("autocorr_trend") > 0, F.col("autocorr_trend_r2"))) + 0.25 * part(F.when(F.col("variance_trend") > 0, F.col("variance_trend_r2"))) + 0.2 * part(F.abs("skewness"))
    out = out.withColumns({"recovery_rate": F.when(ac > 0, -F.ln(ac)), "variance_ratio": F.try_divide(F.col("variance"), F.nullif(F.col("var0"), F.lit(0.0))), "csd_score": score})
    return out.drop("var0").withColumn("csd_detected", F.coalesce((F.col("csd_score") > 0.6) & (ac > 0.7) & (F.col("variance_trend") > 0), F.lit(False)))
