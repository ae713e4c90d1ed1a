"""Local linear analysis of trajectories: saddles, basins, separatrices, sensitivity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .dynamics import _last
from .windows import SIGNAL, arrays, spread


#: Distances held at once.
CELLS = 500_000
#: Points of a leaf, in the search of neighbours, have twice this number at most.
LEAF = 32


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Places of points that lie together: halved at the median of the widest axis."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= 2 * LEAF:
            done.append(at)
            continue
        own = x[at, np.ptp(x[at], axis=0).argmax()]
        by, half = np.argpartition(own, len(at) // 2), len(at) // 2
        todo += [at[by[:half]], at[by[half:]]]
    return done


def _first(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k points of ``x`` nearest to each of ``q``, as a stable sort has them."""
    d = K.squares(q[:, None], x[None])
    if len(x) <= 4 * k:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    r, c = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    by = np.lexsort((c, d[r, c], r))
    return c[by][np.searchsorted(r, np.arange(len(q)))[:, None] + np.arange(k)]


def nearest(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, near, of): the first of every distinct point's places, the places of the k points
    nearest to it (of equally far ones the earlier), and the distinct point at every place.

    The same as sorting all distances.  Of equal points only the first k can be among the
    nearest; the rest lie in leaves, and those are looked into whose box is as near as the
    k-th of the points in the nearest leaves."""
    n = len(p)
    order = np.lexsort(p.T[::-1])
    new = np.append(True, (p[order[1:]] != p[order[:-1]]).any(1))
    group = new.cumsum() - 1
    of = np.empty(n, np.int64)
    of[order] = group
    first = order[new]
    pool = np.sort(order[np.arange(n) - np.flatnonzero(new)[group] < k])
    x, asks = p[pool], np.zeros(n, bool)
    asks[first] = True
    near = np.empty((len(first), k), np.int64)
    leaves = _leaves(x)
    low, high = np.array([x[at].min(0) for at in leaves]), np.array([x[at].max(0) for at in leaves])
    for i, at in enumerate(leaves):
        at = at[asks[pool[at]]]
        if not len(at):
            continue
        gap = K.squares(np.maximum(np.maximum(low - high[i], low[i] - high), 0), np.zeros(p.shape[1]))
        by = np.argsort(gap, kind="stable")
        some = np.concatenate([leaves[j] for j in by[: 4 + k // LEAF * 2]])
        for part in np.array_split(at, min(len(at), -(-len(at) * len(some) // CELLS))):
            far = np.partition(K.squares(x[part, None], x[some][None]), k - 1, axis=1)[:, k - 1].max()
            seen = np.sort(np.concatenate([leaves[j] for j in by[: np.searchsorted(gap[by], far * (1 + 1e-9), "right")]]))
            for q in np.array_split(part, min(len(part), -(-len(part) * len(seen) // CELLS))):
                near[of[pool[q]]] = pool[seen[_first(x[q], x[seen], k)]]
    return first, near, of


def jacobians(x: np.ndarray, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(velocity, Jacobian) at every point but the last: least squares of the k nearest
    points' velocities over their offsets.  Points are taken in blocks, so that memory grows
    with the length."""
    v = np.diff(x, axis=0)
    p = x[:-1]
    n, d = p.shape
    k = min(max(k, d + 2), n)
    first, near, of = nearest(p, k)
    out = np.empty((n, d, d))
    block = max(1, CELLS // (k * d))
    inverse = np.empty((len(first), d, k))
    for low in range(0, len(first), block):
        own = slice(low, low + block)
        inverse[own] = np.linalg.pinv(p[near[own]] - p[first[own], None], rcond=1e-6)
    for low in range(0, n, block):
        own = of[low : low + block]
        out[low : low + block] = (inverse[own] @ (v[near[own]] - v[low : low + block, None])).transpose(0, 2, 1)
    return v, out


def saddles(x: np.ndarray, k: int = 10) -> dict[str, float]:
    """How saddle-like the trajectory's points are (eigenvalues of both signs at low speed),
    the share of contracting points, and the distance to the nearest saddle."""
    names = ("saddle_score_mean", "saddle_score_max", "saddle_score_current", "saddle_fraction", "basin_stability_mean", "basin_stability_current", "separatrix_distance_current", "n_valid")
    if len(x) < 15 or x.std() < 1e-12:
        return dict.fromkeys(names, K.NAN) | {"n_valid": float(len(x))}
    v, j = jacobians(x, k)
    e = np.linalg.eigvals(j).real
    speed = np.sqrt((v**2).sum(1))
    slow = 1 / (1 + speed / (np.median(speed) + 1e-12))
    up, down = np.maximum(e, 0).sum(1), np.maximum(-e, 0).sum(1)
    score = 2 * np.minimum(up, down) / (up + down + 1e-12) * slow
    basin = down / (up + down + 1e-12)
    at = np.flatnonzero(score > 0.5)
    p = x[:-1]
    gap = float(np.sqrt(((p[at] - p[-1]) ** 2).sum(1)).min()) if len(at) else K.NAN
    return dict(zip(names, (float(score.mean()), float(score.max()), float(score[-1]), float((score > 0.5).mean()), float(basin.mean()), float(basin[-1]), gap, float(len(p))), strict=True))


SADDLE = list(saddles(np.zeros((3, 2))))


def sensitivity(x: np.ndarray, horizon: int = 5, k: int = 10) -> dict[str, np.ndarray]:
    """Growth of a small push along each variable over ``horizon`` steps of the local linear
    maps; shares, ranks and the mean influence of variables on each other."""
    v, j = jacobians(x, k)
    n, d = len(v), x.shape[1]
    step = np.eye(d) + j
    m = np.tile(np.eye(d), (n, 1, 1))
    for t in range(min(horizon, n)):  # the maps of points near the end are fewer
        m[: n - t] = step[t:] @ m[: n - t]
    grown, total = np.sqrt((m**2).sum(1)), np.abs(m).sum(0)
    share = grown / np.maximum(grown.sum(1, keepdims=True), 1e-12)
    dominant = share.argmax(1)
    h = -(share * np.log(np.maximum(share, 1e-12))).sum(1) / np.log(max(2, d))
    return {"sensitivity": grown, "share": share, "dominant": dominant, "entropy": h, "transitions": np.flatnonzero(np.diff(dominant)) + 1, "influence": total / n}


def saddle_detection(obs: DataFrame, dim: int = 3) -> DataFrame:
    """Of every signal, embedded at its own delay, over all its rows."""

    def run(batches):
        for b in batches:
            rows = []
            for c, s, y in zip(b["cohort"], b["signal_id"], b["y"], strict=True):
                y = K.clean(y)
                delay = K.optimal_delay(y) if len(y) >= 30 else 1
                f = saddles(K.embed(y, dim, delay))
                rows.append((c, s, dim, delay, *[f[k] for k in SADDLE]))
            yield pd.DataFrame(rows, columns=[*SIGNAL, "embedding_dim", "embedding_tau", *SADDLE])

    made = _last(obs, None, SIGNAL).mapInPandas(run, "cohort string, signal_id string, embedding_dim int, embedding_tau int, " + ", ".join(f"{c} double" for c in SADDLE))
    return made.select(*SIGNAL, "embedding_dim", "embedding_tau", *[F.nanvl(c, F.lit(None)).alias(c) for c in SADDLE])


def saddle_rolling(obs: DataFrame, window: int = 100, stride: int = 20, dim: int = 3) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(r.cohort, r.signal_id, r.window_id, r.signal_0_end, *[saddles(K.embed(K.clean(r.y), dim, 1))[k] for k in ("saddle_score_current", "basin_stability_current")]) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=[*SIGNAL, "window_id", "signal_0_end", "rolling_saddle_score", "rolling_basin_stability"])

    return arrays(obs, window, stride).select(*SIGNAL, "window_id", "signal_0_end", "y").mapInPandas(run, "cohort string, signal_id string, window_id long, signal_0_end double, rolling_saddle_score double, rolling_basin_stability double")


def _gathered(states: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(cohort, x): a cohort's complete states in their order."""
    rows = states.select("cohort", order, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).dropna()
    made = rows.groupBy("cohort").agg(F.sort_array(F.collect_list(F.struct(order, F.array(*columns).alias("x")))).alias("p"))
    return spread(made.select("cohort", F.transform("p", lambda v: v["x"]).alias("x")))


def saddle_multivariate(states: DataFrame, columns: list[str], order: str = "signal_0_end", least: int = 15) -> DataFrame:
    """Saddles of each cohort's joint trajectory through ``columns``: without embedding, of
    the 2 d + 1 nearest states.  For tables of states (a row a window)."""

    def run(batches):
        for b in batches:
            rows = []
            for c, x in b[["cohort", "x"]].itertuples(index=False):
                x = np.stack([np.asarray(v, float) for v in x])
                f = saddles(x, 2 * x.shape[1] + 1) if len(x) >= least else dict.fromkeys(SADDLE, K.NAN) | {"n_valid": float(len(x))}
                rows.append((c, *[f[k] for k in SADDLE]))
            yield pd.DataFrame(rows, columns=["cohort", *SADDLE])

    made = _gathered(states, columns, order).mapInPandas(run, "cohort string, " + ", ".join(f"{c} double" for c in SADDLE))
    return made.select("cohort", *[F.nanvl(c, F.lit(None)).alias(c) for c in SADDLE])


RECURRENCE = list(K.rqa(np.eye(2)))


def recurrence_measures(states: DataFrame, columns: list[str], order: str = "signal_0_end", share: float = 0.1) -> DataFrame:
    """Recurrence measures of each cohort's trajectory through ``columns``: points recur within
    the distance that ``share`` of all pairs have.  All pairs are seen, some at a time."""

    def run(batches):
        for b in batches:
            rows = []
            for c, x in b[["cohort", "x"]].itertuples(index=False):
                x = np.stack([np.asarray(v, float) for v in x])
                rows.append((c, len(x), *K.recurrence_of_states(x, share).values()))
            yield pd.DataFrame(rows, columns=["cohort", "n_points", *RECURRENCE])

    return _gathered(states, columns, order).mapInPandas(run, "cohort string, n_points long, " + ", ".join(f"{c} double" for c in RECURRENCE))


def sensitivity_of_vector(vector: DataFrame, feature: str, signals: list[str], window: int = 20, stride: int = 10) -> DataFrame:
    """Sensitivity of the trajectory that a feature of all signals makes, a row a window end."""
    cells = [F.avg(F.when(F.col("signal_id") == s, F.col(feature))).alias(s) for s in signals]
    wide = vector.groupBy("cohort", F.col("signal_0_end").alias("signal_0")).agg(*cells)
    return trajectory_sensitivity(wide, signals, window, stride)


def trajectory_sensitivity(wide: DataFrame, signals: list[str], window: int = 100, stride: int = 50) -> DataFrame:
    """A row for each window and variable: current and mean sensitivity, rank, whether it
    dominates, and the window's entropy and number of changes of the dominant one.  A
    cohort's windows are gathered row by row, each of bounded size."""
    long = wide.select("cohort", F.lit("state").alias("signal_id"), "signal_0", F.lit(0.0).alias("value"), F.array(*[F.coalesce(F.col(s), F.lit(0.0)) for s in signals]).alias("x"))
    from pyspark.sql import Window

    order = Window.partitionBy("cohort").orderBy("signal_0")
    rows = long.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("cohort"))})
    low = F.greatest(F.ceil((F.col("i") - (window - 1)) / stride), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col("i") / stride), F.floor((F.col("n") - window) / stride)).cast("long")
    each = rows.where(F.col("n") >= window).select("cohort", "signal_0", "i", "x", F.explode(F.when(low <= high, F.sequence(low, high))).alias("window_id"))
    made = each.groupBy("cohort", "window_id").agg(F.sort_array(F.collect_list(F.struct("i", "signal_0", "x"))).alias("p"))

    def run(batches):
        for b in batches:
            out = []
            for c, w, p in b[["cohort", "window_id", "p"]].itertuples(index=False):
                x = np.stack([np.asarray(v["x"], float) for v in p])
                sd = x.std(0)
                f = sensitivity((x - x.mean(0)) / np.where(sd > 1e-12, sd, 1.0))
                rank = np.argsort(np.argsort(-f["sensitivity"][-1], kind="stable")) + 1
                for k, s in enumerate(signals):
                    out.append((c, w, float(p[-1]["signal_0"]), s, float(f["sensitivity"][-1, k]), float(f["sensitivity"][:, k].mean()), int(rank[k]), bool(f["dominant"][-1] == k), float(f["entropy"].mean()), len(f["transitions"]), f["influence"][k].tolist()))
            yield pd.DataFrame(out, columns=["cohort", "window_id", "signal_0_end", "signal_id", "current_sensitivity", "mean_sensitivity", "current_rank", "is_dominant", "sensitivity_entropy", "n_transitions", "influence"])

    return spread(made).mapInPandas(run, "cohort string, window_id long, signal_0_end double, signal_id string, current_sensitivity double, mean_sensitivity double, current_rank int, is_dominant boolean, sensitivity_entropy double, n_transitions int, influence array<double>")
