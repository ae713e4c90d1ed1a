"""Machine-learning features of cohorts: window metrics, curve features, trajectory and
cross-axis features, and the feature matrix."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

WINDOW_METRICS = [
    "effective_dim", "condition_number", "total_variance", "eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "eigenvalue_entropy", "ratio_2_1", "ratio_3_1", "mean_dist_to_centroid", "mean_abs_correlation",
    "centroid_kurtosis", "centroid_perm_entropy", "centroid_spectral_flatness", "algebraic_connectivity", "centroid_hurst", "kurtosis", "perm_entropy",
]


def window_metrics(x: np.ndarray) -> dict[str, float]:
    """Of a window's (signals, time) matrix."""
    out = dict.fromkeys(WINDOW_METRICS, K.NAN)
    n, t = x.shape
    if n < 2 or t < 4:
        return out
    cov = np.cov(x)
    val = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0)
    total = val.sum()
    p = val[val > 1e-15] / total if total > 1e-15 else np.zeros(0)
    centre = x.mean(0)
    sd = x.std(1)
    good = sd > 1e-12
    corr = np.corrcoef(x[good]) if good.sum() >= 2 else np.zeros((0, 0))
    out.update(
        effective_dim=float(total**2 / (val**2).sum()) if total > 1e-15 else K.NAN, condition_number=float(val[0] / max(val[-1], 1e-15)), total_variance=float(total), **{f"eigenvalue_{i + 1}": float(val[i]) if i < n else 0.0 for i in range(3)},
        eigenvalue_entropy=float(-(p * np.log(p)).sum()) if len(p) else K.NAN, ratio_2_1=float(val[1] / val[0]) if val[0] > 0 else 0.0, ratio_3_1=float(val[2] / val[0]) if n > 2 and val[0] > 0 else 0.0,
        mean_dist_to_centroid=float(np.sqrt(((x - centre) ** 2).sum(1)).mean()), mean_abs_correlation=float(np.abs(corr[np.triu_indices(len(corr), 1)]).mean()) if len(corr) >= 2 else K.NAN,
        centroid_kurtosis=K.shape(centre)["kurtosis"], centroid_perm_entropy=K.permutation_entropy(centre), centroid_spectral_flatness=K.spectrum(centre)["spectral_flatness"], centroid_hurst=K.rescaled_range(centre)["hurst"],
    )
    out.update(kurtosis=out["centroid_kurtosis"], perm_entropy=out["centroid_perm_entropy"])
    if len(corr) >= 3:
        a = np.abs(corr)
        np.fill_diagonal(a, 0)
        deg = a.sum(1)
        inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1e-300)), 0)
        out["algebraic_connectivity"] = float(np.linalg.eigvalsh(np.diag((deg > 0).astype(float)) - inv[:, None] * a * inv)[1])
    return out


def cohort_windows(wide: DataFrame, signals: list[str], window: int = 50, stride: int = 24) -> DataFrame:
    """(cohort, window_id, metrics): windows over a cohort's rows (short cohorts: one over
    all), each gathered by itself."""
    order = Window.partitionBy("cohort").orderBy("signal_0")
    rows = wide.select("cohort", "signal_0", F.array(*[F.coalesce(F.col(s), F.lit(0.0)) for s in signals]).alias("x"))
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("cohort"))})
    low = F.greatest(F.ceil((F.col("i") - (window - 1)) / stride), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col("i") / stride), F.floor((F.col("n") - window) / stride)).cast("long")
    span = F.when(F.col("n") < window, F.array(F.lit(0).cast("long"))).when(low <= high, F.sequence(low, high))
    each = rows.select("cohort", "i", "signal_0", "x", F.explode(span).alias("window_id"))
    made = each.groupBy("cohort", "window_id").agg(F.sort_array(F.collect_list(F.struct("i", "signal_0", "x"))).alias("p"))

    def run(batches):
        for b in batches:
            out = []
            for c, w, p in b[["cohort", "window_id", "p"]].itertuples(index=False):
                m = window_metrics(np.stack([np.asarray(v["x"], float) for v in p], 1))
                out.append((c, w, float(p[-1]["signal_0"]), *[m[k] for k in WINDOW_METRICS]))
            yield pd.DataFrame(out, columns=["cohort", "window_id", "signal_0_end", *WINDOW_METRICS])

    return made.mapInPandas(run, "cohort string, window_id long, signal_0_end double, " + ", ".join(f"{m} double" for m in WINDOW_METRICS))


CURVE = ["mean", "std", "min", "max", "first", "last", "delta", "range", "spike_ratio", "slope", "r2", "early_mean", "mid_mean", "late_mean", "early_late_delta", "vel_mean", "vel_std", "vel_max", "vel_min", "vel_late_mean", "acc_mean", "acc_std", "acc_max", "acc_min", "curvature_mean"]


def curve_features(long: DataFrame, keys: list[str], value: str = "value", order: str = "t") -> DataFrame:
    """25 features of a curve: summary, line, thirds, first and second differences."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    w, all_rows = Window.partitionBy(*keys).orderBy("o"), Window.partitionBy(*keys)
    rows = rows.withColumns({"i": (F.row_number().over(w) - 1).cast("double"), "n": F.count("*").over(all_rows), "vel": F.col("v") - F.lag("v").over(w)})
    rows = rows.withColumn("acc", F.col("vel") - F.lag("vel").over(w))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    early, late = F.col("i") < third, F.col("i") >= F.col("n") - third
    v, i = F.col("v"), F.col("i")
    flat = F.var_pop(v) < 1e-15
    mean = F.avg(v)
    made = {
        "mean": mean, "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "first": F.min_by("v", "o"), "last": F.max_by("v", "o"), "delta": F.max_by("v", "o") - F.min_by("v", "o"), "range": F.max(v) - F.min(v),
        "spike_ratio": F.when(F.abs(mean) > 1e-10, F.max(v) / mean), "slope": F.coalesce(F.regr_slope(v, i), F.lit(0.0)), "r2": F.when(flat | (F.count(v) < 2), 0.0).otherwise(F.regr_r2(v, i)),
        "early_mean": F.avg(F.when(early, v)), "mid_mean": F.coalesce(F.avg(F.when(~early & ~late, v)), mean), "late_mean": F.avg(F.when(late, v)), "early_late_delta": F.avg(F.when(late, v)) - F.avg(F.when(early, v)),
        "vel_mean": F.avg("vel"), "vel_std": F.stddev_pop("vel"), "vel_max": F.max("vel"), "vel_min": F.min("vel"), "vel_late_mean": F.avg(F.when(late, F.col("vel"))),
        "acc_mean": F.avg("acc"), "acc_std": F.stddev_pop("acc"), "acc_max": F.max("acc"), "acc_min": F.min("acc"), "curvature_mean": F.avg(F.abs("acc") / F.pow(1 + F.col("vel") * F.col("vel"), F.lit(1.5))),
    }
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in made.items()])


def signal_curves(obs: DataFrame, signals: list[str]) -> DataFrame:
    """A row a cohort: the curve features of each of its signals."""
    made = curve_features(obs, ["cohort", "signal_id"], "value", "signal_0")
    cells = [F.max(F.when(F.col("signal_id") == s, F.col(c))).alias(f"{s}_{c}") for s in signals for c in CURVE]
    return made.groupBy("cohort").agg(*cells)


def fingerprint_matrix(windows: DataFrame, metrics: list[str] = WINDOW_METRICS) -> DataFrame:
    """A row a cohort: every window metric's curve features."""
    long = windows.unpivot(["cohort", "window_id"], metrics, "metric", "value")
    made = curve_features(long, ["cohort", "metric"], "value", "window_id")
    cells = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in metrics for c in CURVE]
    return made.groupBy("cohort").agg(*cells)


def normalise_with(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Values of ``rows`` as z-scores by the training observations' signals."""
    stats = train.groupBy("signal_id").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    z = F.when(F.col("__s") > 1e-10, (F.col("value") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return rows.join(F.broadcast(stats), "signal_id").select("cohort", "signal_id", "signal_0", z.alias("value"))


AXIS_METRICS = ["effective_dim", "condition_number", "total_variance", "eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "effective_dim_velocity", "effective_dim_acceleration", "effective_dim_curvature", "speed", "curvature", "acceleration_magnitude"]


def single_axis_features(signatures: DataFrame, axis: str, match: DataFrame | None = None) -> DataFrame:
    """Summaries of each metric along a cohort's trajectory: whole, early and late thirds,
    slope, quarters by arc length, and position-weighted means."""
    w, per = Window.partitionBy("cohort").orderBy("signal_0_end"), Window.partitionBy("cohort")
    rows = signatures.withColumns({"i": (F.row_number().over(w) - 1).cast("double"), "n": F.count("*").over(per), "total": F.max("arc_length").over(per)})
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    early, late = F.col("i") < third, F.col("i") >= F.col("n") - third
    place = F.coalesce(F.try_divide(F.col("arc_length"), F.nullif(F.col("total"), F.lit(0.0))), F.lit(0.0))
    weight = F.pow(F.try_divide(F.col("i") + 1, F.col("n").cast("double")), F.lit(2.0))
    aggs: list[Column] = [F.max("total").alias(f"{axis}_arc_length_total"), F.count("*").alias(f"{axis}_n_windows")]
    for m in AXIS_METRICS:
        v, name = F.col(m), f"{axis}_{m}"
        e, la = F.avg(F.when(early, v)), F.avg(F.when(late, v))
        aggs += [F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), (F.max(v) - F.min(v)).alias(f"{name}_range"), e.alias(f"{name}_early"), la.alias(f"{name}_late"), (la - e).alias(f"{name}_delta"), F.regr_slope(v, F.col("i")).alias(f"{name}_slope")]
        aggs += [F.avg(F.when((place >= q / 4) & (place < (q + 1) / 4), v)).alias(f"{name}_q{q + 1}") for q in range(3)]
        aggs.append(F.try_divide(F.sum(weight * v), F.sum(F.when(v.isNotNull(), weight))).alias(f"{name}_pos_weighted"))
    mean = F.avg("condition_number")
    aggs += [F.regr_slope("curvature", "i").alias(f"{axis}_curvature_trend"), F.avg(F.when(late, F.col("curvature") * F.col("speed"))).alias(f"{axis}_curvature_speed_product_late"), F.when(F.abs(mean) > 1e-10, F.max("condition_number") / mean).alias(f"{axis}_cond_spike_ratio")]
    made = rows.groupBy("cohort").agg(*aggs)
    if match is not None:
        own = ["trajectory_id", "match_distance", "second_distance", "match_confidence", "trajectory_position"]
        made = made.join(match.select("cohort", *[F.col(c).alias(f"{axis}_{c}") for c in own]), "cohort", "left")
    return made


def sub_window_features(geometry: DataFrame, axis: str, degenerate: float = 100.0) -> DataFrame:
    """Spread of sub-windows' geometry within windows, along the trajectory."""
    each = geometry.groupBy("cohort", "signal_0_end").agg(F.min("effective_dim").alias("dmin"), (F.max("effective_dim") - F.min("effective_dim")).alias("dspread"), F.max("condition_number").alias("cmax"), (F.max("condition_number") - F.min("condition_number")).alias("cspread"))
    w, per = Window.partitionBy("cohort").orderBy("signal_0_end"), Window.partitionBy("cohort")
    rows = each.withColumns({"i": (F.row_number().over(w) - 1).cast("double"), "n": F.count("*").over(per)})
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    early, late = F.col("i") < third, F.col("i") >= F.col("n") - third
    bad = F.count_if(F.col("cmax") > degenerate)
    p = f"{axis}_sub_"
    part = lambda c, when: F.avg(F.when(when, F.col(c)))
    return rows.groupBy("cohort").agg(
        F.avg("dmin").alias(f"{p}eff_dim_min_mean"), F.min("dmin").alias(f"{p}eff_dim_min_min"), F.avg("cmax").alias(f"{p}cond_max_mean"), F.max("cmax").alias(f"{p}cond_max_max"), F.avg("dspread").alias(f"{p}eff_dim_spread_mean"), F.max("dspread").alias(f"{p}eff_dim_spread_max"), F.avg("cspread").alias(f"{p}cond_spread_mean"), F.max("cspread").alias(f"{p}cond_spread_max"),
        bad.alias(f"{p}n_degenerate"), (bad / F.count("*")).alias(f"{p}frac_degenerate"), part("dmin", early).alias(f"{p}eff_dim_min_early"), part("dmin", late).alias(f"{p}eff_dim_min_late"), (part("dmin", late) - part("dmin", early)).alias(f"{p}eff_dim_min_delta"),
        part("cmax", early).alias(f"{p}cond_max_early"), part("cmax", late).alias(f"{p}cond_max_late"), (part("cmax", late) - part("cmax", early)).alias(f"{p}cond_max_delta"), F.regr_slope("dmin", "i").alias(f"{p}eff_dim_min_slope"), F.regr_slope("dspread", "i").alias(f"{p}eff_dim_spread_slope"),
    )


def cross_axis_features(matrix: DataFrame, axes: list[str], collapse: float = -0.15) -> DataFrame:
    """Agreement of the axes: how many collapse, how their late states differ."""
    delta = [F.col(f"{a}_effective_dim_delta") for a in axes]
    cond, dim = [F.col(f"{a}_condition_number_late") for a in axes], [F.col(f"{a}_effective_dim_late") for a in axes]
    falls = sum((F.coalesce((d < collapse).cast("int"), F.lit(0)) for d in delta), F.lit(0))
    known = lambda cs: F.filter(F.array(*cs), lambda v: v.isNotNull())
    mean = lambda cs: F.try_divide(F.aggregate(known(cs), F.lit(0.0), lambda a, v: a + v), F.nullif(F.size(known(cs)), F.lit(0)).cast("double"))
    std = lambda cs: F.sqrt(F.try_divide(F.aggregate(known(cs), F.lit(0.0), lambda a, v: a + F.pow(v - mean(cs), F.lit(2.0))), F.nullif(F.size(known(cs)), F.lit(0)).cast("double")))
    out = {
        "cross_n_axes_collapsing": falls, "cross_collapse_on_any": (falls > 0).cast("int"), "cross_collapse_on_all": (falls == len(axes)).cast("int"), "cross_min_dim_delta": F.array_min(known(delta)), "cross_max_dim_delta": F.array_max(known(delta)), "cross_mean_dim_delta": mean(delta), "cross_dim_delta_spread": F.array_max(known(delta)) - F.array_min(known(delta)),
        "cross_cond_late_mean": mean(cond), "cross_cond_late_max": F.array_max(known(cond)), "cross_cond_late_std": std(cond), "cross_dim_late_mean": mean(dim), "cross_dim_late_min": F.array_min(known(dim)), "cross_dim_late_std": std(dim),
    }
    ids = [f"{a}_trajectory_id" for a in axes if f"{a}_trajectory_id" in matrix.columns]
    if ids:
        distinct = F.size(F.array_distinct(F.array_compact(F.array(*ids))))
        out |= {"cross_n_distinct_trajectories": distinct, "cross_trajectory_agreement": (distinct == 1).cast("int")}
    return matrix.select("cohort", *[c.alias(k) for k, c in out.items()])


def feature_matrix(parts: list[DataFrame]) -> DataFrame:
    """Full outer join of cohorts' feature tables, then without columns that do not vary."""
    from ..sources.validation import drop_dead_columns

    return drop_dead_columns(reduce(lambda a, b: a.join(b, "cohort", "full"), parts), ["cohort"], 1.0)


def with_remaining_life(features: DataFrame, life: DataFrame) -> DataFrame:
    """Features with ``rul`` of (cohort, rul); cohorts without one keep null."""
    return features.join(F.broadcast(life.select("cohort", "rul")) if _is_small(life) else life.select("cohort", "rul"), "cohort", "left")


def _is_small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows
