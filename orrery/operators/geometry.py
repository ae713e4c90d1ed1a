"""Eigen-geometry of a cohort's signals in feature space.

Means and covariances are aggregations; a row of sums, not the rows themselves, meets the
eigen solver.  Effective dimension needs no eigenvalues: it is the squared trace of the
covariance over its squared Frobenius norm, which also makes the jackknife an
expression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import t_quantile
from ..schemas import available_groups
from .state import POINT, _finite

TOP = 5


def spectrum_of(cov: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """Summary of a covariance, and its eigenvectors by falling eigenvalue, each with its
    largest component (the first of those that are equal but for rounding) positive."""
    vals, vecs = np.linalg.eigh(cov)
    vals, vecs = np.maximum(vals[::-1], 0), vecs[:, ::-1]
    size = np.abs(vecs)
    big = (size >= size.max(0) * (1 - 1e-6)).argmax(0)
    vecs = vecs * np.where(vecs[big, np.arange(len(vals))] < 0, -1, 1)
    total = vals.sum()
    p = vals / total if total > 1e-15 else np.zeros_like(vals)
    h = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    low = vals[vals > 1e-12]
    out = {f"eigenvalue_{i + 1}": float(vals[i]) if i < len(vals) else 0.0 for i in range(TOP)}
    out |= {f"explained_{i + 1}": float(p[i]) if i < len(vals) else 0.0 for i in range(TOP)}
    out |= {
        "effective_dim": float(total**2 / (vals**2).sum()) if total > 1e-15 else np.nan, "total_variance": float(total), "eigenvalue_entropy": h, "eigenvalue_entropy_norm": h / np.log2(len(vals)) if len(vals) > 1 else 0.0,
        "condition_number": float(vals[0] / low[-1]) if len(low) else np.nan, "ratio_2_1": float(vals[1] / vals[0]) if len(vals) > 1 and vals[0] > 0 else 0.0, "ratio_3_1": float(vals[2] / vals[0]) if len(vals) > 2 and vals[0] > 0 else 0.0,
    }
    return out, vecs


SUMMARY = [*[f"eigenvalue_{i + 1}" for i in range(TOP)], *[f"explained_{i + 1}" for i in range(TOP)], "effective_dim", "total_variance", "eigenvalue_entropy", "eigenvalue_entropy_norm", "condition_number", "ratio_2_1", "ratio_3_1"]


def covariances(rows: DataFrame, keys: list[str], features: list[str], least: int = 2, extra: dict[str, Column] | None = None) -> DataFrame:
    """(keys, extra, n, mean, std, cov): sample covariance of the rows that are complete, flat
    by rows.  D (D + 1) / 2 aggregates, pre-aggregated before the exchange; ``extra``:
    aggregates that are wanted beside them."""
    extra = extra or {}
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    pair = {(a, b): F.covar_samp(a, b) for i, a in enumerate(features) for b in features[i:]}
    made = rows.where(complete).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(f) for f in features]).alias("mean"), F.array(*[F.stddev_pop(f) for f in features]).alias("std"), *[c.alias(f"__{a}__{b}") for (a, b), c in pair.items()], *[c.alias(k) for k, c in extra.items()])
    flat = F.array(*[F.col(f"__{min(a, b, key=features.index)}__{max(a, b, key=features.index)}") for a in features for b in features])
    return made.where(F.col("n") >= least).select(*keys, *extra, "n", "mean", "std", flat.alias("cov"))


def decompose(cov: DataFrame, keys: list[str], standardise: bool = True) -> DataFrame:
    """Adds the eigen summary and ``pc`` (three directions, flat).  ``standardise``: of the
    z-scored features (population deviation); a group with a constant one has no row."""
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                d = len(r["mean"])
                c, s = np.asarray(r["cov"], float).reshape(d, d), np.asarray(r["std"], float)
                if standardise:
                    if (s < 1e-12).any():
                        continue
                    c = c / np.outer(s, s)
                summary, vecs = spectrum_of(c)
                pc = np.zeros((3, d))
                pc[: min(3, d)] = vecs.T[:3]
                rows.append([*[r[k] for k in keys], int(r["n"]), r["mean"], r["std"], *[summary[c] for c in SUMMARY], pc.ravel()])
            yield pd.DataFrame(rows, columns=[*keys, "n", "mean", "std", *SUMMARY, "pc"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, mean array<double>, std array<double>", *[f"{c} double" for c in SUMMARY], "pc array<double>"])
    return cov.mapInPandas(run, schema)


def _component(features: list[str], which: int) -> Column:
    """Score of a row on a direction: dot of its z-scores with the direction."""
    d = len(features)
    return sum((F.try_divide(F.col(f) - F.col("mean")[i], F.col("std")[i]) * F.col("pc")[which * d + i] for i, f in enumerate(features)), F.lit(0.0))


def _steady(made: DataFrame, d: int) -> DataFrame:
    """Directions whose sign follows the window before: the sign of a window is the product
    of all turns up to it, which is a running count of them.  Counts the turns; a
    direction without variance, here or before, is arbitrary and has none."""
    order = Window.partitionBy("cohort", "engine").orderBy("window_id")
    dots = [sum((F.col("pc")[k * d + i] * F.lag("pc").over(order)[k * d + i] for i in range(d)), F.lit(0.0)) for k in range(3)]
    real = [F.least(F.col(f"eigenvalue_{k + 1}"), F.lag(f"eigenvalue_{k + 1}").over(order)) > 1e-9 for k in range(3)]
    made = made.withColumns({f"__t{k}": F.when(real[k] & (dots[k] < 0), 1).otherwise(0) for k in range(3)})
    made = made.withColumns({f"__s{k}": 1 - 2 * (F.sum(f"__t{k}").over(order) % 2) for k in range(3)})
    signed = F.array(*[F.col("pc")[k * d + i] * F.col(f"__s{k}") for k in range(3) for i in range(d)])
    return made.withColumns({"pc": signed, "eigenvector_flip_count": F.col("__t0") + F.col("__t1") + F.col("__t2")}).drop(*[f"__{x}{k}" for x in "ts" for k in range(3)])


def jackknife(rows: DataFrame, keys: list[str], features: list[str], level: float = 0.95) -> DataFrame:
    """(keys, eff_dim_std, eff_dim_ci_low, eff_dim_ci_high): leaving one row out changes
    the sums by that row alone."""
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    rows = rows.where(complete)
    w = Window.partitionBy(*keys)
    # centred first: sums of squares of raw values would cancel
    rows = rows.select(*keys, *[(F.col(f) - F.avg(f).over(w)).alias(f) for f in features], F.count("*").over(w).cast("double").alias("n"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    rows = rows.withColumns({f"p__{a}__{b}": F.sum(F.col(a) * F.col(b)).over(w) for a, b in pairs}).where("n >= 4")
    m = F.col("n") - 1
    cov = {(a, b): F.try_divide(F.col(f"p__{a}__{b}") - F.col(a) * F.col(b) - F.try_divide(F.col(a) * F.col(b), m), m - 1) for a, b in pairs}
    trace = sum((cov[a, a] for a in features), F.lit(0.0))
    norm = sum((cov[a, b] * cov[a, b] * (1 if a == b else 2) for a, b in pairs), F.lit(0.0))
    each = rows.withColumn("e", F.when(norm > 1e-30, trace * trace / norm))
    made = each.groupBy(*keys).agg(F.count("e").alias("k"), F.avg("e").alias("centre"), F.stddev_pop("e").alias("s"))
    table = F.udf(lambda k: t_quantile(0.5 + level / 2, max(1, k - 1)), "double")
    # the quantile depends on the number of rows alone: one call for each number
    sizes = made.select("k").distinct().withColumn("t", table("k"))
    se = F.sqrt((F.col("k") - 1).cast("double")) * F.col("s")
    return made.join(F.broadcast(sizes), "k").select(*keys, se.alias("eff_dim_std"), (F.col("centre") - F.col("t") * se).alias("eff_dim_ci_low"), (F.col("centre") + F.col("t") * se).alias("eff_dim_ci_high"))


def cohort_geometry(vector: DataFrame, groups: dict[str, list[str]] | None = None, with_jackknife: bool = True) -> dict[str, DataFrame]:
    """``geometry`` (cohort, window, engine), ``positions`` of the signals on the first
    three directions, and ``loadings`` of the features on the first."""
    made: dict[str, list[DataFrame]] = {"geometry": [], "positions": [], "loadings": []}
    for engine, features in (groups or available_groups(vector.columns)).items():
        d = len(features)
        rows = vector.select(*POINT, "signal_id", *[_finite(f).alias(f) for f in features])
        keys = ["cohort", "window_id"]
        ends = {"signal_0_start": F.min("signal_0_start"), "signal_0_end": F.max("signal_0_end"), "signal_0_center": F.avg("signal_0_center")}
        eigen = decompose(covariances(rows, keys, features, 2, ends), [*keys, *ends]).withColumn("engine", F.lit(engine))
        eigen = geometry = _steady(eigen, d)
        if with_jackknife:
            geometry = geometry.join(jackknife(rows, keys, features), keys, "left")
        else:
            geometry = geometry.withColumns({c: F.lit(None).cast("double") for c in ("eff_dim_std", "eff_dim_ci_low", "eff_dim_ci_high")})
        columns = [*POINT, "engine", F.col("n").alias("n_signals"), F.lit(d).cast("long").alias("n_features"), *SUMMARY, "eff_dim_std", "eff_dim_ci_low", "eff_dim_ci_high", "eigenvector_flip_count"]
        made["geometry"].append(geometry.select(*columns))
        complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
        placed = rows.where(complete).join(eigen.select(*keys, "engine", "mean", "std", "pc"), keys)
        made["positions"].append(placed.select(*POINT, "engine", "signal_id", *[_component(features, k).alias(f"pc{k + 1}_loading") for k in range(3)]))
        pairs = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.slice("pc", 1, d).alias("value")))
        made["loadings"].append(eigen.select(*keys, "engine", pairs.alias("x")).select(*keys, "engine", F.col("x.feature").alias("feature"), F.col("x.value").alias("pc1_loading")))
    return {k: reduce(DataFrame.unionByName, v) for k, v in made.items()}


def effective_dim(vector: DataFrame, features: list[str]) -> DataFrame:
    """Effective dimension of the raw features, without an eigen solver."""
    rows = vector.select("cohort", "window_id", *[_finite(f).alias(f) for f in features])
    d = len(features)
    trace = sum((F.col("cov")[i * d + i] for i in range(d)), F.lit(0.0))
    norm = sum((F.col("cov")[i] * F.col("cov")[i] for i in range(d * d)), F.lit(0.0))
    return covariances(rows, ["cohort", "window_id"], features).select("cohort", "window_id", F.col("n").alias("n_signals"), trace.alias("total_variance"), F.when(norm > 1e-30, trace * trace / norm).alias("effective_dim"))


def signal_dominance(positions: DataFrame) -> DataFrame:
    """How strongly signals load on the first direction, by engine and over all."""
    rows = positions.withColumn("a", F.abs("pc1_loading"))
    both = rows.select("engine", "signal_id", "signal_0_end", "cohort", "a", "pc1_loading").unionByName(rows.select(F.lit("aggregate").alias("engine"), "signal_id", "signal_0_end", "cohort", "a", "pc1_loading"))
    made = both.groupBy("engine", "signal_id").agg(F.avg("a").alias("mean_abs_loading"), F.max_by("a", F.struct("signal_0_end", "cohort", "a")).alias("final_abs_loading"), F.signum(F.avg("pc1_loading")).alias("loading_sign"), F.count("*").alias("n_windows"))
    return made.withColumn("dominance_rank", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("mean_abs_loading"), "signal_id")))


def signal_geometry(vector: DataFrame, geometry_pc: DataFrame | None, centres: DataFrame, engine: str, features: list[str]) -> DataFrame:
    """Each signal against its cohort's centroid: distance, alignment with the first
    direction, share along the centroid, what is left, size.  Features that a signal
    lacks count as the centroid's."""
    rows = vector.select("cohort", "window_id", "signal_0_end", "signal_id", *[_finite(f).alias(f) for f in features]).join(centres.select("cohort", "window_id", *[F.col(f"state_{engine}_{f}").alias(f"c_{f}") for f in features]), ["cohort", "window_id"])
    none = F.coalesce(*features).isNull()
    x = {f: F.coalesce(F.col(f), F.col(f"c_{f}"), F.lit(0.0)) for f in features}
    c = {f: F.coalesce(F.col(f"c_{f}"), F.lit(0.0)) for f in features}
    total = lambda terms: sum(terms, F.lit(0.0))
    dist, size, centre = F.sqrt(total([(x[f] - c[f]) * (x[f] - c[f]) for f in features])), F.sqrt(total([x[f] * x[f] for f in features])), F.sqrt(total([c[f] * c[f] for f in features]))
    along = F.try_divide(total([x[f] * c[f] for f in features]), F.nullif(centre, F.lit(0.0)))
    coherence = F.lit(None).cast("double")
    if geometry_pc is not None:
        own = geometry_pc.where(F.col("engine") == engine).groupBy("cohort", "window_id").pivot("feature", features).agg(F.first("pc1_loading"))
        rows = rows.join(own.select("cohort", "window_id", *[F.col(f).alias(f"v_{f}") for f in features]), ["cohort", "window_id"], "left")
        coherence = F.try_divide(total([(x[f] - c[f]) * F.col(f"v_{f}") for f in features]), F.nullif(dist, F.lit(0.0)))
    made = {"distance": dist, "coherence": coherence, "contribution": along, "residual": F.sqrt(F.greatest(size * size - along * along, F.lit(0.0))), "signal_magnitude": size}
    return rows.select("cohort", "window_id", "signal_0_end", "signal_id", F.lit(engine).alias("engine"), *[F.when(~none, v).alias(k) for k, v in made.items()])
