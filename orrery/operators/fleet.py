"""The fleet: cohorts as points of one system."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .dynamics import FLOOR, ftle, velocity_field
from .geometry import SUMMARY, covariances, decompose
from .pairwise import dtw, feature_pairs, information_flow
from .windows import spread

METRICS = ["effective_dim", "eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "explained_1", "total_variance", "condition_number", "ratio_2_1", "ratio_3_1", "eigenvalue_entropy", "eigenvalue_entropy_norm"]
ENGINES = ("complexity", "shape", "spectral")


def pivot_geometry(geometry: DataFrame, engines: tuple[str, ...] = ENGINES, metrics: list[str] = METRICS) -> DataFrame:
    """A row for each (cohort, window): engine by metric, and the change of each engine's
    effective dimension.  Conditional aggregates: the engines are known."""
    keys = ["cohort", "window_id", "signal_0_end"]
    cells = [F.max(F.when(F.col("engine") == e, F.col(m))).alias(f"{e}_{m}") for e in engines for m in metrics]
    made = geometry.groupBy(*keys).agg(*cells)
    order = Window.partitionBy("cohort").orderBy("window_id")
    return made.withColumns({f"{e}_eff_dim_rate": F.col(f"{e}_effective_dim") - F.lag(f"{e}_effective_dim").over(order) for e in engines})


def features_of(wide: DataFrame) -> list[str]:
    return [c for c, k in wide.dtypes if k == "double" and c not in ("signal_0_end", "signal_0_start", "signal_0_center")]


def _complete(wide: DataFrame, features: list[str]) -> DataFrame:
    return wide.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features]))


def system_vector(wide: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Centroid of the cohorts in each window, and their distances to it."""
    own = features or features_of(wide)
    w = Window.partitionBy("window_id")
    rows = wide.withColumns({f"c_{f}": F.avg(f).over(w) for f in own})
    square = sum((F.pow(F.col(f) - F.col(f"c_{f}"), F.lit(2.0)) for f in own), F.lit(0.0))
    rows = rows.withColumn("d", F.sqrt(square))
    return rows.groupBy("window_id").agg(F.max("signal_0_end").alias("signal_0_end"), F.count("*").alias("n_cohorts"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"), F.stddev_pop("d").alias("std_distance"), *[F.first(f"c_{f}").alias(f"centroid_{f}") for f in own])


def system_geometry(wide: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """Eigen summary of the complete cohorts of each window, and their first scores."""
    keys, d = ["window_id"], len(features)
    rows = _complete(wide, features)
    eigen = decompose(covariances(rows, keys, features, max(2, d + 1)), keys)
    score = sum((F.try_divide(F.col(f) - F.col("mean")[i], F.col("std")[i]) * F.col("pc")[i] for i, f in enumerate(features)), F.lit(0.0))
    positions = rows.join(eigen.select("window_id", "mean", "std", "pc"), "window_id").select("window_id", "signal_0_end", "cohort", F.lit("system").alias("engine"), score.alias("pc1_loading"))
    return {"geometry": eigen.select("window_id", F.col("n").alias("n_cohorts"), F.lit(d).cast("long").alias("n_features"), *SUMMARY), "positions": positions}


def system_pairwise(wide: DataFrame, features: list[str], positions: DataFrame | None = None, threshold: float = 0.3) -> DataFrame:
    made = feature_pairs(_complete(wide, features), "system", features, positions, None, threshold, "cohort", ("cohort_a", "cohort_b"), ("window_id",))
    gate = F.lit(True) if positions is None else F.col("needs_granger")
    return made.select("window_id", "cohort_a", "cohort_b", "distance", "cosine_similarity", "correlation", "pc1_coloading", gate.alias("needs_granger"))


def cohort_series(wide: DataFrame, feature: str) -> DataFrame:
    """A feature of the cohorts as observations of one system."""
    return wide.select(F.lit("system").alias("cohort"), F.col("cohort").alias("signal_id"), F.col("window_id").cast("double").alias("signal_0"), F.col(feature).cast("double").alias("value"))


def system_information_flow(wide: DataFrame, feature: str = "shape_effective_dim", flagged: DataFrame | None = None, least: int = 20) -> DataFrame:
    own = None if flagged is None else flagged.where("needs_granger").select(F.lit("system").alias("cohort"), F.col("cohort_a").alias("signal_a"), F.col("cohort_b").alias("signal_b"))
    return information_flow(cohort_series(wide, feature), own, least, names=("cohort_a", "cohort_b"), keys=())


def system_ftle(wide: DataFrame, feature: str = "shape_effective_dim", least: int = 30) -> DataFrame:
    rows = cohort_series(wide, feature)
    both = ftle(rows, "forward", least=least).unionByName(ftle(rows, "backward", least=least))
    return both.drop("cohort").withColumnRenamed("signal_id", "cohort")


def system_velocity_field(wide: DataFrame, features: list[str]) -> DataFrame:
    """Motion of each cohort through its features, a missing one replaced by its mean.
    Steps that are rounding alone count as none."""
    w, order = Window.partitionBy("cohort"), Window.partitionBy("cohort").orderBy("signal_0_end")
    rows = wide.withColumns({f: F.coalesce(F.nanvl(f, F.lit(None)), F.avg(F.nanvl(f, F.lit(None))).over(w), F.lit(0.0)) for f in features}).withColumn("n", F.count("*").over(w)).where("n >= 3")
    step = F.col("signal_0_end") - F.lag("signal_0_end").over(order)  # null at the first row
    rows = rows.withColumn("dt", F.when(step.isNotNull(), F.greatest(step, F.lit(FLOOR))))
    rows = rows.withColumns({f"v_{f}": (F.col(f) - F.lag(f).over(order)) / F.col("dt") for f in features})
    rows = rows.withColumns({f"v_{f}": F.when(F.abs(f"v_{f}") < 1e-12, 0.0).otherwise(F.col(f"v_{f}")) for f in features})
    mid = (F.col("dt") + F.lag("dt").over(order)) / 2
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"v_{f}").alias("velocity"), ((F.col(f"v_{f}") - F.lag(f"v_{f}").over(order)) / mid).alias("acceleration")) for f in features])
    each = rows.withColumn("p", parts).where(F.col("dt").isNotNull()).select("cohort", "signal_0_end", F.explode("p").alias("p")).select("cohort", "signal_0_end", "p.*")
    made = velocity_field(each, ("cohort", "signal_0_end"), "feature")
    return made.withColumnsRenamed({"dominant_motion_signal": "dominant_motion_feature"}).drop("dominant_accel_signal", "dominant_motion_fraction")


# ---- trajectories --------------------------------------------------------------------

SIGNATURE = ["eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "effective_dim", "total_variance", "condition_number", "effective_dim_velocity", "effective_dim_acceleration", "effective_dim_curvature", "speed", "curvature", "acceleration_magnitude"]


def trajectory_signatures(geometry: DataFrame, dynamics: DataFrame, velocity: DataFrame, engine: str = "shape") -> DataFrame:
    """Geometry, its derivatives and the cohort's motion at the same points, and the arc
    length so far."""
    g = geometry.where(F.col("engine") == engine).select("cohort", "signal_0_end", *SIGNATURE[:6])
    d = dynamics.where(F.col("engine") == engine).select("cohort", "signal_0_end", *SIGNATURE[6:9])
    v = velocity.select("cohort", F.col("signal_0").alias("signal_0_end"), "speed", "curvature", "acceleration_magnitude")
    rows = g.join(d, ["cohort", "signal_0_end"]).join(v, ["cohort", "signal_0_end"])
    order = Window.partitionBy("cohort").orderBy("signal_0_end")
    step = F.sqrt(sum((F.coalesce(F.pow(F.col(c) - F.lag(c).over(order), F.lit(2.0)), F.lit(0.0)) for c in SIGNATURE), F.lit(0.0)))
    return rows.withColumn("step", step).withColumn("arc_length", F.sum("step").over(order)).withColumn("torsion", F.lit(None).cast("double")).drop("step")


def _resample(x: np.ndarray, n: int) -> np.ndarray:
    at = np.linspace(0, len(x) - 1, n)
    return np.stack([np.interp(at, np.arange(len(x)), x[:, k]) for k in range(x.shape[1])], 1)


def signature_distances(signatures: DataFrame, length: int | None = None, columns: list[str] = SIGNATURE, block: int = 32) -> DataFrame:
    """(a, b, distance) of all cohorts: dynamic time warping of each scaled dimension,
    meaned, over trajectories resampled to the median length.  Cohorts are dealt into
    blocks; a pair of blocks is one unit of work, and a trajectory travels once to each."""
    scale = signatures.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    order = F.sort_array(F.collect_list(F.struct("signal_0_end", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])))
    rows = signatures.groupBy("cohort").agg(order.alias("x"))
    size = length or int(rows.agg(F.percentile(F.size("x"), 0.5)).first()[0] or 1)

    def scaled(c: str):
        return F.transform("x", lambda p: p[c] / (scale[c] or 1.0))

    blocks = max(1, -(-rows.count() // block))
    x = F.array(*[scaled(c) for c in columns]).alias("x")
    rows = rows.select("cohort", x, F.pmod(F.xxhash64("cohort"), F.lit(blocks)).cast("int").alias("at"))
    each = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = each.select(F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "cohort", "x")

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = {c: _resample(np.stack([np.asarray(k, float) for k in v], 1), size) for c, v in zip(b["cohort"], b["x"], strict=True)}
        left, right = (b.loc[b["at"] == k, "cohort"].tolist() for k in key)
        pairs = [(p, q) for p in left for q in right if (p < q if key[0] == key[1] else True)]
        made = [(min(p, q), max(p, q), float(np.mean([dtw(x[p][:, k], x[q][:, k]) for k in range(len(columns))]) / size)) for p, q in pairs]
        return pd.DataFrame(made, columns=["a", "b", "distance"])

    return units.groupBy("i", "j").applyInPandas(run, "a string, b string, distance double")


def ward(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges of Ward's linkage by the Lance-Williams update; clusters are named by their
    smallest member."""
    n = len(d)
    d2, size, alive, merges = d.astype(float) ** 2, np.ones(n), list(range(n)), []
    np.fill_diagonal(d2, np.inf)
    for _ in range(n - 1):
        sub = d2[np.ix_(alive, alive)]
        i, j = np.unravel_index(sub.argmin(), sub.shape)
        a, b = sorted((alive[i], alive[j]))
        for k in alive:
            if k not in (a, b):
                t = size[a] + size[b] + size[k]
                d2[a, k] = d2[k, a] = ((size[a] + size[k]) * d2[a, k] + (size[b] + size[k]) * d2[b, k] - size[k] * d2[a, b]) / t
        size[a] += size[b]
        alive.remove(b)
        merges.append((a, b))
    return merges


def cut(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Labels 0 to k - 1 in order of the clusters' smallest members."""
    root = list(range(n))
    for a, b in merges[: n - k]:
        root = [a if r == b else r for r in root]
    names = {r: i for i, r in enumerate(sorted(set(root)))}
    return np.array([names[r] for r in root])


def silhouette(d: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = np.zeros(len(d))
    for i in range(len(d)):
        own = (label == label[i]) & (np.arange(len(d)) != i)
        if own.any() and len(set(label)) > 1:
            a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label) if c != label[i])
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def trajectory_library(signatures: DataFrame, most_cohorts: int = 5000) -> dict[str, DataFrame]:
    """Clusters of the cohorts' trajectories (``library``) and each cohort's place in them
    (``match``).  The distances are computed in the cluster; Ward's linkage needs their
    matrix in one place and is refused over ``most_cohorts``."""
    spark = signatures.sparkSession
    sizes = {r["cohort"]: r["n"] for r in signatures.groupBy("cohort").agg(F.count("*").alias("n")).orderBy("cohort").limit(most_cohorts + 1).collect()}
    names = sorted(sizes)
    if len(names) > most_cohorts:
        raise ValueError(f"Ward's linkage over more than {most_cohorts} cohorts")
    n = len(names)
    d, at = np.zeros((n, n)), {c: i for i, c in enumerate(names)}
    for r in signature_distances(signatures).collect() if n > 1 else []:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
    best, label = -2.0, np.zeros(n, int)
    merges = ward(d) if n > 1 else []
    for k in range(2, min(max(2, n // 3), 20) + 1) if n >= 3 else []:
        own = cut(merges, n, k)
        score = silhouette(d, own).mean()
        if score > best + 1e-12:
            best, label = score, own
    s = silhouette(d, label)
    library, match, medoids = [], [], {}
    for c in sorted(set(label.tolist())):
        own = np.flatnonzero(label == c)
        inner = d[np.ix_(own, own)]
        medoids[c] = own[inner.sum(1).argmin()]
        intra = float(inner.sum() / max(1, len(own) * (len(own) - 1)))
        other = np.flatnonzero(label != c)
        inter = float(d[np.ix_(own, other)].mean()) if len(other) else float("nan")
        library.append((int(c), len(own), names[medoids[c]], ",".join(names[i] for i in own), intra, inter if inter == inter else None, float(s[own].mean()), intra / inter if inter and inter == inter else None, float(np.mean([sizes[names[i]] for i in own]))))
    for i, name in enumerate(names):
        order = sorted((float(d[i, m]), c) for c, m in medoids.items())
        first, second = order[0], order[1] if len(order) > 1 else (None, None)
        sure = 1.0 if second[0] is None or second[0] <= 0 else max(0.0, 1 - first[0] / second[0])
        match.append((name, int(first[1]), first[0], second[0], sure, sizes[name] / max(sizes.values()), sizes[name]))
    return {
        "library": spark.createDataFrame(library, "trajectory_id int, n_members int, medoid_cohort string, member_cohorts string, mean_intra_distance double, mean_inter_distance double, silhouette double, compactness double, mean_n_windows double"),
        "match": spark.createDataFrame(match, "cohort string, trajectory_id int, match_distance double, second_distance double, match_confidence double, trajectory_position double, n_windows long"),
    }


# ---- exponent fields -----------------------------------------------------------------


def adjacent_pairs(points: np.ndarray, k: int = 3) -> list[tuple[int, int]]:
    """Gabriel neighbours in the plane of the first two axes (a subset of the Delaunay
    edges), joined with the k nearest in all axes."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    near = {tuple(sorted((i, int(j)))) for i in range(n) for j in np.argsort(d[i], kind="stable")[1 : k + 1]}
    flat = points[:, :2]
    f = ((flat[:, None] - flat[None]) ** 2).sum(2)
    gabriel = {(i, j) for i in range(n) for j in range(i + 1, n) if not ((f[i] + f[j])[np.arange(n) != i] < f[i, j] - 1e-15)[np.arange(n - 1) != j - 1].any()}
    return sorted(near | gabriel)


def local_exponent(at: np.ndarray, cloud: np.ndarray, moved: np.ndarray, k: int = 10) -> float:
    """Log stretch of the linear map that carries the k nearest points to where they went."""
    if len(cloud) < 4:
        return K.NAN
    near = np.argsort(((cloud - at) ** 2).sum(1), kind="stable")[:k]
    x, y = cloud[near] - cloud[near].mean(0), moved[near] - moved[near].mean(0)
    m, *_ = np.linalg.lstsq(x, y, rcond=1e-8)
    s = np.linalg.svd(m, compute_uv=False)
    return float(np.log(max(s[0], 1e-12)))


def ftle_field(geometry: DataFrame, most_cohorts: int = 5000, steps: int = 20, across: int = 5) -> DataFrame:
    """Ridges of deformation between neighbouring cohorts' centroids in the space of the
    first three eigenvalues, by engine.

    Centroids and net displacements are aggregations and travel to all tasks (one point a
    cohort, refused over ``most_cohorts``); the pairs are rows."""
    axes = ["eigenvalue_1", "eigenvalue_2", "eigenvalue_3"]
    made = geometry.groupBy("engine", "cohort").agg(*[F.avg(a).alias(a) for a in axes], *[(F.max_by(a, "signal_0_end") - F.min_by(a, "signal_0_end")).alias(f"d_{a}") for a in axes])
    rows = made.dropna().orderBy("engine", "cohort").limit(most_cohorts * 10 + 1).collect()
    if len(rows) > most_cohorts * 10:
        raise ValueError("too many cohorts for one field")
    clouds: dict[str, tuple[list[str], np.ndarray, np.ndarray]] = {}
    for engine in sorted({r["engine"] for r in rows}):
        own = [r for r in rows if r["engine"] == engine]
        if len(own) >= 10:
            x = np.array([[r[a] for a in axes] for r in own], float)
            clouds[engine] = ([r["cohort"] for r in own], x, x + np.array([[r[f"d_{a}"] for a in axes] for r in own], float))
    pairs = [(e, int(i), int(j)) for e, (_, x, _) in clouds.items() for i, j in adjacent_pairs(x)]
    schema = "engine string, centroid_a string, centroid_b string, ridge_strength double, ridge_width double, corridor_width double, ridge_location array<double>, inter_centroid_distance double"
    spark = geometry.sparkSession
    if not pairs:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for engine, i, j in b[["engine", "i", "j"]].itertuples(index=False):
                names, x, moved = clouds[engine]
                line = x[j] - x[i]
                gap = float(np.linalg.norm(line))
                side = np.cross(line, [0.0, 0.0, 1.0])
                side = side / np.linalg.norm(side) if np.linalg.norm(side) > 1e-12 else np.array([1.0, 0, 0])
                t, u = np.linspace(0, 1, steps), np.linspace(-0.25, 0.25, across) * gap
                grid = np.array([[local_exponent(x[i] + a * line + w * side, x, moved) for w in u] for a in t])
                mean = np.nanmean(grid, 1)
                top = int(np.nanargmax(mean))
                high = mean >= np.nanmin(mean) + 0.5 * (mean[top] - np.nanmin(mean))
                cross = grid[top]
                out.append((engine, names[i], names[j], float(mean[top] - np.nanmedian(mean)), float(high.mean() * gap), float((cross >= np.nanmedian(cross)).mean() * np.ptp(u)), (x[i] + t[top] * line).tolist(), gap))
            yield pd.DataFrame(out, columns=["engine", "centroid_a", "centroid_b", "ridge_strength", "ridge_width", "corridor_width", "ridge_location", "inter_centroid_distance"])

    return spark.createDataFrame(pairs, "engine string, i int, j int").mapInPandas(run, schema)


def basins(geometry: DataFrame, most_cohorts: int = 5000, directions: int = 8, radii: int = 3, together: int = 64) -> DataFrame:
    """How deep each cohort's centroid lies: the rise of the local exponent from the centroid
    outwards, the radius at which it is steepest, the direction in which it rises least
    (where the state escapes), and how many directions stay low."""
    axes = ["eigenvalue_1", "eigenvalue_2", "eigenvalue_3"]
    made = geometry.groupBy("engine", "cohort").agg(*[F.avg(a).alias(a) for a in axes], *[(F.max_by(a, "signal_0_end") - F.min_by(a, "signal_0_end")).alias(f"d_{a}") for a in axes]).dropna()
    cloud = made.groupBy("engine").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("cohort", F.array(*axes).alias("x"), F.array(*[F.col(f"d_{a}") for a in axes]).alias("d")))).alias("p")).where((F.col("n") >= 10) & (F.col("n") <= most_cohorts))
    # the cloud travels once for every ``together`` of its cohorts
    rows = spread(cloud.select("engine", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1, F.lit(together))).alias("first")))

    def points(b: pd.DataFrame):
        for engine, p, first in b[["engine", "p", "first"]].itertuples(index=False):
            x = np.array([v["x"] for v in p], float)
            moved = x + np.array([v["d"] for v in p], float)
            for k in range(first, min(first + together, len(p))):
                yield engine, p[k]["cohort"], x[k], x, moved

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = np.linspace(0, 2 * np.pi, directions, endpoint=False)
        rays = np.stack([np.cos(turn), np.sin(turn), np.zeros(directions)], 1)
        for b in batches:
            out = []
            for engine, cohort, at, x, moved in points(b):
                scale = float(np.median(np.sqrt(((x - at) ** 2).sum(1)))) or 1.0
                steps = scale * np.arange(1, radii + 1) / radii
                base = local_exponent(at, x, moved)
                rise = np.array([[local_exponent(at + r * ray, x, moved) - base for r in steps] for ray in rays])
                mean = rise.mean(1)
                low = int(mean.argmin())
                out.append((engine, cohort, float(rise.mean()), float(steps[rise.mean(0).argmax()]), rays[low].tolist(), int((mean <= 0.25 * max(mean.max(), 0)).sum())))
            yield pd.DataFrame(out, columns=["engine", "centroid_id", "basin_depth", "basin_radius", "escape_direction", "n_corridors"])

    return rows.mapInPandas(run, "engine string, centroid_id string, basin_depth double, basin_radius double, escape_direction array<double>, n_corridors int")
