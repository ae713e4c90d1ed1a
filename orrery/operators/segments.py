"""Segments of the axis, baselines, and observations against them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import SUMMARY, covariances, decompose, spectrum_of
from .pairwise import PAIR, aligned, granger
from .windows import spread

Segment = tuple[str, float, float | None]


def default_segments(obs: DataFrame, share: float = 0.2) -> list[Segment]:
    """The first fifth of the axis, and the rest."""
    row = obs.agg(F.min("signal_0").alias("a"), F.max("signal_0").alias("b")).first()
    if row["a"] is None:
        return []
    cut = share * row["b"]
    return [("early", float(row["a"]), float(cut)), ("late", float(np.nextafter(cut, np.inf)), None)]


def in_segments(rows: DataFrame, segments: list[Segment], axis: str = "signal_0") -> DataFrame:
    """Rows with the segment they lie in, both ends included."""
    name = F.lit(None).cast("string")
    for s, a, b in reversed(segments):
        inside = (F.col(axis) >= a) & (F.lit(True) if b is None else F.col(axis) <= b)
        name = F.when(inside, s).otherwise(name)
    return rows.withColumn("segment", name).where("segment is not null")


def segment_geometry(wide: DataFrame, signals: list[str], segments: list[Segment]) -> DataFrame:
    """Eigen summary of the signals' covariance (z-scored) in each segment."""
    keys = ["cohort", "segment"]
    made = decompose(covariances(in_segments(wide, segments), keys, signals, max(10, 2 * len(signals))), keys)
    return made.select(*keys, F.col("n").alias("n_samples"), F.lit(len(signals)).cast("long").alias("n_signals"), *SUMMARY, (F.col("eigenvalue_1") - F.col("eigenvalue_2")).alias("spectral_gap"))


def segment_comparison(wide: DataFrame, signals: list[str], segments: list[Segment]) -> DataFrame:
    """Each segment against the one after it."""
    rows = segment_geometry(wide, signals, segments)
    order = {s: i for i, (s, _, _) in enumerate(segments)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    rows = rows.withColumn("o", F.element_at(place, F.col("segment")))
    names = {"effective_dim": "eff_dim", "eigenvalue_1": "eigenvalue_1", "explained_1": "explained_1", "condition_number": "condition_number", "spectral_gap": "spectral_gap", "n_samples": "n_samples"}
    a, b = (rows.select("cohort", F.col("o").alias(f"o_{s}"), F.col("segment").alias(f"segment_{s}"), *[F.col(c).alias(f"{n}_{s}") for c, n in names.items()]) for s in "ab")
    made = a.join(b, "cohort").where("o_a + 1 = o_b").drop("o_a", "o_b")
    return made.withColumns({"eff_dim_delta": F.col("eff_dim_b") - F.col("eff_dim_a"), "eigenvalue_1_delta": F.col("eigenvalue_1_b") - F.col("eigenvalue_1_a")})


def info_flow_delta(obs: DataFrame, segments: list[Segment], lag: int = 5, most: int = 2000, alpha: float = 0.05, flagged: DataFrame | None = None) -> DataFrame:
    """Granger links of ordered pairs (of those ``flagged``) in two segments, and what became
    of them."""
    rows = in_segments(aligned(obs, flagged), segments)
    w = Window.partitionBy(*PAIR, "segment").orderBy(F.desc("signal_0"))
    last = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    series = last.groupBy(*PAIR, "segment").agg(F.sort_array(F.collect_list(F.struct("signal_0", "x", "y"))).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, s, t, segment, p in b[[*PAIR, "segment", "p"]].itertuples(index=False):
                x, y = np.array([v["x"] for v in p], float), np.array([v["y"] for v in p], float)
                for source, target, pair in ((s, t, granger(x, y, lag)), (t, s, granger(y, x, lag))):
                    out.append((c, source, target, segment, *pair))
            yield pd.DataFrame(out, columns=["cohort", "source", "target", "segment", "f", "p"])

    found = series.mapInPandas(run, "cohort string, source string, target string, segment string, f double, p double")
    first, second = segments[0][0], segments[1][0]
    keys = ["cohort", "source", "target"]
    side = lambda name, s: found.where(F.col("segment") == name).select(*keys, F.nanvl("f", F.lit(None)).alias(f"f_stat_{s}"), F.nanvl("p", F.lit(None)).alias(f"p_value_{s}"))
    made = side(first, "a").join(side(second, "b"), keys, "full")
    a, b = F.coalesce(F.col("p_value_a") < alpha, F.lit(False)), F.coalesce(F.col("p_value_b") < alpha, F.lit(False))
    ratio = F.try_divide(F.col("f_stat_b"), F.nullif(F.col("f_stat_a"), F.lit(0.0)))
    status = F.when(~a & ~b, "absent").when(~a & b, "emerged").when(a & ~b, "dissolved").when(ratio > 1.5, "strengthened").when(ratio < 0.67, "weakened").otherwise("stable")
    return made.select(*keys, F.lit(first).alias("segment_a"), F.lit(second).alias("segment_b"), "f_stat_a", "f_stat_b", (F.col("f_stat_b") - F.col("f_stat_a")).alias("f_stat_delta"), "p_value_a", "p_value_b", a.alias("significant_a"), b.alias("significant_b"), status.alias("link_status"))


def sensor_eigendecomp(wide: DataFrame, signals: list[str], window: int = 30, stride: int = 5, history: int = 30) -> DataFrame:
    """Eigen summary of the last ``history`` rolling means of the signals, at each mean.

    A frame of ``history`` means travels with each point, which is less than its covariances
    as soon as there are more signals than that."""
    order = Window.partitionBy("cohort").orderBy("signal_0")
    frame = order.rowsBetween(-(window - 1), 0)
    rows = wide.withColumns({"i": F.row_number().over(order) - 1, **{f"m_{s}": F.avg(s).over(frame) for s in signals}}).where((F.col("i") >= window - 1) & ((F.col("i") - (window - 1)) % stride == 0))
    rows = rows.select("cohort", "signal_0", *[F.coalesce(F.col(f"m_{s}") - F.avg(f"m_{s}").over(Window.partitionBy("cohort")), F.lit(0.0)).alias(s) for s in signals])
    past = F.collect_list(F.array(*signals)).over(order.rowsBetween(-(history - 1), 0))
    made = rows.select("cohort", "signal_0", past.alias("p")).where(F.size("p") >= 5)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, at, p in b.itertuples(index=False):
                x = np.stack([np.asarray(v, float) for v in p])
                sd = x.std(0)
                if (sd >= 1e-12).all():
                    summary, _ = spectrum_of(np.atleast_2d(np.cov(x.T)) / np.outer(sd, sd))
                    out.append((c, at, len(x), *[summary[k] for k in SUMMARY]))
            yield pd.DataFrame(out, columns=["cohort", "signal_0", "n", *SUMMARY])

    out = spread(made).mapInPandas(run, "cohort string, signal_0 double, n long, " + ", ".join(f"{k} double" for k in SUMMARY))
    return out.select("cohort", F.col("signal_0").alias("signal_0_end"), F.lit(len(signals)).cast("long").alias("n_signals"), F.col("n").alias("n_samples"), *SUMMARY, F.pow(F.lit(2.0), F.col("eigenvalue_entropy")).alias("eff_dim_entropy"), F.col("explained_1").alias("energy_concentration"))


def cohort_baseline(wide: DataFrame, signals: list[str], share: float = 0.2, pooled: bool = False) -> DataFrame:
    """Centre, spread and directions of each cohort's first rows (at least three), or of all
    cohorts' together."""
    order = Window.partitionBy("cohort").orderBy("signal_0")
    rows = wide.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("cohort"))})
    early = rows.where(F.col("i") <= F.greatest(F.ceil(F.col("n") * share), F.lit(3)))
    if pooled:
        early = early.withColumn("cohort", F.lit("fleet"))
    made = decompose(covariances(early, ["cohort"], signals, 3), ["cohort"])
    return made.select("cohort", F.col("n").alias("n_baseline_cycles"), F.lit(len(signals)).cast("long").alias("n_signals"), *[F.col(c).alias(f"baseline_{c}") for c in SUMMARY], F.col("mean").alias("centroid"), F.col("std").alias("std"), F.col("pc").alias("principal_directions"), F.to_json("mean").alias("centroid_json"), F.to_json("std").alias("std_json"), F.to_json("pc").alias("principal_directions_json"), F.lit(",".join(signals)).alias("signal_ids"))


def observation_geometry(wide: DataFrame, baseline: DataFrame, signals: list[str]) -> DataFrame:
    """Every observation against its cohort's baseline (or the fleet's)."""
    d = len(signals)
    own = baseline.select("cohort", "centroid", "std", "principal_directions", F.array(*[F.col(f"baseline_eigenvalue_{k}") for k in range(1, 4)]).alias("val"))
    fleet = own.where("cohort = 'fleet'").drop("cohort")
    # the fleet's baseline is one row
    rows = wide.join(F.broadcast(fleet), F.lit(1) == 1) if _is_pooled(baseline) else wide.join(own, "cohort")
    z = [F.when(F.col("std")[i] > 1e-12, (F.col(s) - F.col("centroid")[i]) / F.col("std")[i]).otherwise(0.0) for i, s in enumerate(signals)]
    rows = rows.withColumns({f"z_{s}": F.coalesce(v, F.lit(0.0)) for s, v in zip(signals, z, strict=True)})
    score = [sum((F.col(f"z_{s}") * F.col("principal_directions")[k * d + i] for i, s in enumerate(signals)), F.lit(0.0)) for k in range(3)]
    raw = F.sqrt(sum((F.pow(F.coalesce(F.col(s) - F.col("centroid")[i], F.lit(0.0)), F.lit(2.0)) for i, s in enumerate(signals)), F.lit(0.0)))
    norm = F.sqrt(sum((F.col(f"z_{s}") * F.col(f"z_{s}") for s in signals), F.lit(0.0)))
    maha = F.sqrt(sum((F.when(F.col("val")[k] > 1e-10, score[k] * score[k] / F.col("val")[k]).otherwise(0.0) for k in range(3)), F.lit(0.0)))
    size = F.sqrt(sum((F.coalesce(F.col(s) * F.col(s), F.lit(0.0)) for s in signals), F.lit(0.0)))
    return rows.select("cohort", "signal_0", raw.alias("centroid_distance"), norm.alias("centroid_distance_norm"), score[0].alias("pc1_projection"), score[1].alias("pc2_projection"), maha.alias("mahalanobis_approx"), size.alias("sensor_norm"))


def _is_pooled(baseline: DataFrame) -> bool:
    return baseline.where("cohort = 'fleet'").limit(1).count() == 1
