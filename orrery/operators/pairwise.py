"""Pairs of signals: geometry in feature space, and dependence of their series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .sql_engines import safe_corr
from .state import _finite
from .windows import spread

PAIR = ["cohort", "signal_a", "signal_b"]


def feature_pairs(vector: DataFrame, engine: str, features: list[str], positions: DataFrame | None = None, centres: DataFrame | None = None, threshold: float = 0.1, entity: str = "signal_id", names: tuple[str, str] = ("signal_a", "signal_b"), keys: tuple[str, ...] = ("cohort", "window_id")) -> DataFrame:
    """All pairs of a group's complete entities: distance, cosine, correlation across the
    features, where they stand to the centroid, and whether they load on the first
    direction together.  An equi join on the group, the pair's order as condition."""
    d = len(features)
    rows = vector.select(*keys, F.col(entity).alias("e"), F.array(*[_finite(f) for f in features]).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    group = Window.partitionBy(*keys)
    centre = F.array(*[F.avg(F.col("x")[i]).over(group) for i in range(d)])
    rows = rows.withColumn("c", centre)
    dot = lambda p, q: sum((p[i] * q[i] for i in range(d)), F.lit(0.0))
    gap = lambda p, q: F.sqrt(sum(((p[i] - q[i]) * (p[i] - q[i]) for i in range(d)), F.lit(0.0)))
    rows = rows.withColumn("r", gap(F.col("x"), F.col("c"))).withColumn("mean_r", F.avg("r").over(group))
    if positions is not None:
        own = positions.where(F.col("engine") == engine).select(*keys, F.col(entity).alias("e"), F.col("pc1_loading").alias("l")).dropDuplicates([*keys, "e"])
        rows = rows.join(own, [*keys, "e"], "left")
    else:
        rows = rows.withColumn("l", F.lit(None).cast("double"))
    side = lambda s: rows.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("e", "x", "r", "l")], *([F.col("c"), F.col("mean_r")] if s == "a" else []))
    pairs = side("a").join(side("b"), list(keys)).where("e_a < e_b")
    x, y, c = F.col("x_a"), F.col("x_b"), F.col("c")
    na, nb = F.sqrt(dot(x, x)), F.sqrt(dot(y, y))
    cosine = F.when((na > 1e-12) & (nb > 1e-12), dot(x, y) / (na * nb)).otherwise(0.0)
    mx, my = sum((x[i] for i in range(d)), F.lit(0.0)) / d, sum((y[i] for i in range(d)), F.lit(0.0)) / d
    sxy, sxx, syy = (sum(((p[i] - mp) * (q[i] - mq) for i in range(d)), F.lit(0.0)) for p, mp, q, mq in ((x, mx, y, my), (x, mx, x, mx), (y, my, y, my)))
    corr = cosine if d == 1 else F.when((sxx > 1e-24) & (syy > 1e-24), sxy / F.sqrt(sxx * syy)).otherwise(0.0)
    load = F.coalesce(F.abs(F.col("l_a") * F.col("l_b")), F.lit(0.0))
    return pairs.select(
        *keys, F.lit(engine).alias("engine"), F.col("e_a").alias(names[0]), F.col("e_b").alias(names[1]), gap(x, y).alias("distance"), cosine.alias("cosine_similarity"), corr.alias("correlation"),
        ((F.col("r_a") < F.col("mean_r")) & (F.col("r_b") < F.col("mean_r"))).alias("both_close_to_state"), ((F.col("r_a") > F.col("mean_r")) & (F.col("r_b") > F.col("mean_r"))).alias("both_far_from_state"),
        (dot(x, c) * dot(y, c) > 0).alias("same_side_of_state"), F.abs(F.col("r_a") - F.col("r_b")).alias("state_distance_diff"), load.alias("pc1_coloading"), (load > threshold).alias("needs_granger"),
    )


def aligned(obs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(cohort, signal_a, signal_b, signal_0, x, y): pairs of values at equal signal_0.
    ``only`` (cohort, signal_a, signal_b): the pairs that are wanted; they meet one side
    before the sides meet, so that no other pair's points are ever made."""
    rows = obs.where("value is not null and not isnan(value)").groupBy("cohort", "signal_id", "signal_0").agg(F.avg("value").alias("v"))
    a = rows.select("cohort", "signal_0", F.col("signal_id").alias("signal_a"), F.col("v").alias("x"))
    b = rows.select("cohort", "signal_0", F.col("signal_id").alias("signal_b"), F.col("v").alias("y"))
    if only is not None:
        wanted = only.select(*PAIR).distinct().where("signal_a < signal_b")
        return a.join(wanted, ["cohort", "signal_a"]).join(b, ["cohort", "signal_0", "signal_b"]).select(*PAIR, "signal_0", "x", "y")
    return a.join(b, ["cohort", "signal_0"]).where("signal_a < signal_b").select(*PAIR, "signal_0", "x", "y")


def correlations(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Pearson, and Spearman on ordinal ranks (ties by order of signal_0)."""
    wx, wy = (Window.partitionBy(*PAIR).orderBy(c, "signal_0") for c in "xy")
    ranked = pairs.withColumns({"rx": F.row_number().over(wx).cast("double"), "ry": F.row_number().over(wy).cast("double")})
    return ranked.groupBy(*PAIR).agg(safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"), F.count("*").alias("n")).where(F.col("n") >= least)


def cross_correlation(pairs: DataFrame, most: int = 10, least: int = 60) -> DataFrame:
    """The largest absolute correlation over shifts of up to ``most`` rows, and its shift:
    lagged columns in one pass, then one aggregate for each shift."""
    w = Window.partitionBy(*PAIR).orderBy("signal_0")
    rows = pairs.withColumns({f"y{k}": F.lead("y", k).over(w) if k > 0 else (F.lag("y", -k).over(w) if k < 0 else F.col("y")) for k in range(-most, most + 1)})
    n = F.count("*")
    corr = lambda k: F.when(F.count(f"y{k}") >= 3, safe_corr("x", f"y{k}"))
    both = [F.struct(F.abs(F.col(f"c{k}")).alias("a"), F.lit(-abs(k)).alias("near"), F.lit(k).alias("lag"), F.col(f"c{k}").alias("c")) for k in range(-most, most + 1)]
    made = rows.groupBy(*PAIR).agg(n.alias("n"), *[corr(k).alias(f"c{k}") for k in range(-most, most + 1)]).where(F.col("n") >= least)
    top = F.array_max(F.filter(F.array(*both), lambda s: s["a"].isNotNull()))
    return made.withColumn("top", top).select(*PAIR, F.col("top.c").alias("max_xcorr"), F.col("top.lag").alias("lag_at_max"), "n")


def _bin(c: str, w, bins: int) -> Column:
    low, high = F.min(c).over(w), F.max(c).over(w)
    at = F.floor(F.try_divide(F.col(c) - low, F.nullif(high - low, F.lit(0.0))) * bins)
    return F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def mutual_information(pairs: DataFrame, bins: int = 10, least: int = 12) -> DataFrame:
    """Plug-in estimate (nats) on equal-width bins; normalised by the root of the
    entropies' product.  Counts of cells, then of their margins."""
    w = Window.partitionBy(*PAIR)
    cells = pairs.withColumns({"i": _bin("x", w, bins), "j": _bin("y", w, bins)}).groupBy(*PAIR, "i", "j").agg(F.count("*").cast("double").alias("c"))
    cells = cells.withColumns({"n": F.sum("c").over(w), "ci": F.sum("c").over(Window.partitionBy(*PAIR, "i")), "cj": F.sum("c").over(Window.partitionBy(*PAIR, "j"))})
    p = F.col("c") / F.col("n")
    made = cells.groupBy(*PAIR).agg(
        F.max("n").cast("long").alias("n"), F.sum(p * F.ln(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))).alias("mi"), (-F.sum(p * F.ln(F.col("ci") / F.col("n")))).alias("hx"), (-F.sum(p * F.ln(F.col("cj") / F.col("n")))).alias("hy"),
    )
    made = made.where(F.col("n") >= least)
    return made.select(*PAIR, F.greatest("mi", F.lit(0.0)).alias("mutual_info"), F.when(F.col("hx") * F.col("hy") > 1e-15, F.greatest("mi", F.lit(0.0)) / F.sqrt(F.col("hx") * F.col("hy"))).otherwise(0.0).alias("normalized_mi"), "n")


def divergences(obs: DataFrame, bins: int = 20, epsilon: float = 1e-10) -> DataFrame:
    """Kullback-Leibler (both ways) and Jensen-Shannon divergence of signals' histograms on
    the pair's common edges."""
    rows = obs.where("value is not null and not isnan(value)")
    ends = rows.groupBy("cohort", "signal_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    a, b = (ends.select("cohort", F.col("signal_id").alias(f"signal_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
    pairs = a.join(b, "cohort").where("signal_a < signal_b").select(*PAIR, F.least("lo_a", "lo_b").alias("lo"), F.greatest("hi_a", "hi_b").alias("hi"))
    both = pairs.select(*PAIR, "lo", "hi", F.explode(F.array(F.struct(F.col("signal_a").alias("signal_id"), F.lit(0).alias("side")), F.struct(F.col("signal_b").alias("signal_id"), F.lit(1).alias("side")))).alias("x"))
    each = rows.join(both.select(*PAIR, "lo", "hi", F.col("x.signal_id").alias("signal_id"), F.col("x.side").alias("side")), ["cohort", "signal_id"])
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = each.withColumn("i", at).groupBy(*PAIR, "i").agg(F.count_if(F.col("side") == 0).cast("double").alias("ca"), F.count_if(F.col("side") == 1).cast("double").alias("cb"))
    w = Window.partitionBy(*PAIR)
    p = counts.withColumns({"p": F.col("ca") / F.sum("ca").over(w), "q": F.col("cb") / F.sum("cb").over(w)})
    kl = lambda x, y: F.sum(F.when(x > 0, x * F.ln((x + epsilon) / (y + epsilon))).otherwise(0.0))
    x, y = F.col("p"), F.col("q")
    m = (x + y) / 2
    return p.groupBy(*PAIR).agg(kl(x, y).alias("kl_divergence_a_to_b"), kl(y, x).alias("kl_divergence_b_to_a"), (0.5 * kl(x, m) + 0.5 * kl(y, m)).alias("js_divergence"))


# ---- kernels of aligned series -------------------------------------------------------


def granger(source: np.ndarray, target: np.ndarray, lag: int = 5) -> tuple[float, float]:
    """F and p of the source's lags in the target's autoregression."""
    n = len(target) - lag
    if len(target) < 25 or target.std() < 1e-12 or source.std() < 1e-12:
        return K.NAN, K.NAN
    own = np.column_stack([np.ones(n), *[target[lag - k : len(target) - k] for k in range(1, lag + 1)]])
    full = np.column_stack([own, *[source[lag - k : len(source) - k] for k in range(1, lag + 1)]])
    _, r, _ = K._ols(own, target[lag:])
    _, u, _ = K._ols(full, target[lag:])
    free = n - full.shape[1]
    if free <= 0 or u <= 1e-300:
        return K.NAN, K.NAN
    f = max(0.0, (r - u) / lag / (u / free))
    return float(f), K.f_tail(f, lag, free)


def transfer_entropy(source: np.ndarray, target: np.ndarray, bins: int = 8) -> float:
    """At lag 1 on equal-width bins, as a share of the target's entropy."""
    if len(target) < 24 or np.ptp(target) < 1e-12 or np.ptp(source) < 1e-12:
        return K.NAN
    cut = lambda v: np.minimum(((v - v.min()) / np.ptp(v) * bins).astype(int), bins - 1)
    s, t = cut(source), cut(target)
    ent = lambda *parts: (lambda c: float(-(c[c > 0] / c.sum() * np.log(c[c > 0] / c.sum())).sum()))(np.bincount(sum(p * bins**i for i, p in enumerate(parts))).astype(float))
    te = ent(t[1:], t[:-1]) + ent(t[:-1], s[:-1]) - ent(t[:-1]) - ent(t[1:], t[:-1], s[:-1])
    h = ent(t)
    return max(0.0, te) / h if h > 1e-12 else 0.0


def dtw(x: np.ndarray, y: np.ndarray) -> float:
    """Classic dynamic time warping of absolute differences, by anti-diagonals."""
    n, m = len(x), len(y)
    if not n or not m:
        return K.NAN
    far = np.full(n + 2, np.inf)
    before, last = far.copy(), far.copy()
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(low, high + 1)
        cost = np.abs(x[i] - y[d - i])
        best = np.minimum(np.minimum(last[i], last[i + 1]), before[i]) if d else np.zeros(1)
        now = far.copy()
        now[i + 1] = cost + best
        before, last = last, now
    return float(last[n])


def cointegration(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    out = {"hedge_ratio": K.NAN, "coint_adf_stat": K.NAN, "is_cointegrated": K.NAN, "half_life": K.NAN, "spread_zscore": K.NAN}
    if len(x) < 30 or x.std() < 1e-10 or y.std() < 1e-10:
        return out
    beta, alpha, _ = K.line(y, x)
    e = x - alpha - beta * y
    stat = K.adf(e, 4)["adf_stat"]
    phi = K.line(e[:-1], e[1:])[0]
    sd = e.std()
    return {"hedge_ratio": beta, "coint_adf_stat": stat, "is_cointegrated": float(stat < -3.34), "half_life": float(-np.log(2) / np.log(phi)) if 0 < phi < 1 else np.inf, "spread_zscore": float(e[-1] / sd) if sd > 1e-12 else K.NAN}


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    i, j = np.triu_indices(len(x), 1)
    s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    n = np.abs(s).sum()
    return float(s.sum() / n) if n else K.NAN


def _frank_tau(theta: float) -> float:
    t = np.linspace(1e-9, abs(theta), 400)
    debye = np.trapezoid(t / np.expm1(t), t) / abs(theta)
    return float(np.sign(theta) * (1 - 4 / abs(theta) * (1 - debye)))


def copula(x: np.ndarray, y: np.ndarray, most: int = 1000) -> dict:
    """Rank copulas by inversion of Kendall's tau; the family of the least AIC; empirical
    tails at the 10 percent corners."""
    out = {"copula_best_family": None, "kendall_tau": K.NAN, "spearman_rho": K.NAN, "lower_tail_dependence": K.NAN, "upper_tail_dependence": K.NAN, "tail_asymmetry": K.NAN}
    if len(x) < 20 or x.std() < 1e-12 or y.std() < 1e-12:
        return out
    if len(x) > most:  # evenly spaced, so that no seed is needed
        at = np.linspace(0, len(x) - 1, most).astype(int)
        x, y = x[at], y[at]
    n = len(x)
    u, v = ((np.argsort(np.argsort(a, kind="stable"), kind="stable") + 1) / (n + 1) for a in (x, y))
    tau, rho = kendall(x, y), float(np.corrcoef(u, v)[0, 1])
    low, high = float(((u <= 0.1) & (v <= 0.1)).sum() / max(1, (u <= 0.1).sum())), float(((u > 0.9) & (v > 0.9)).sum() / max(1, (u > 0.9).sum()))
    out.update(kendall_tau=tau, spearman_rho=rho, lower_tail_dependence=low, upper_tail_dependence=high, tail_asymmetry=high - low)
    if not np.isfinite(tau):
        return out
    score: dict[str, float] = {}
    r = float(np.clip(np.sin(np.pi * tau / 2), -0.999, 0.999))
    a, b = K.normal_quantile(u), K.normal_quantile(v)
    score["gaussian"] = float((-0.5 * np.log(1 - r * r) - (r * r * (a * a + b * b) - 2 * r * a * b) / (2 * (1 - r * r))).sum())
    if 0 < tau < 0.99:
        t = 2 * tau / (1 - tau)
        score["clayton"] = float((np.log1p(t) - (1 + t) * (np.log(u) + np.log(v)) - (2 + 1 / t) * np.log(np.maximum(u**-t + v**-t - 1, 1e-300))).sum())
        g = 1 / (1 - tau)
        lu, lv = -np.log(u), -np.log(v)
        s = (lu**g + lv**g) ** (1 / g)
        score["gumbel"] = float((-s + (g - 1) * np.log(lu * lv) - np.log(u * v) + np.log(s ** (1 - 2 * g) * (s + g - 1))).sum())
    if abs(tau) > 1e-3 and abs(tau) < 0.95:
        lo, hi = (1e-3, 60.0) if tau > 0 else (-60.0, -1e-3)
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _frank_tau(mid) < tau else (lo, mid)
        t = (lo + hi) / 2
        e = -np.expm1(-t)
        den = e - (1 - np.exp(-t * u)) * (1 - np.exp(-t * v))
        score["frank"] = float((np.log(np.abs(t * e)) - t * (u + v) - 2 * np.log(np.abs(den))).sum())
    out["copula_best_family"] = max(score, key=lambda k: (score[k], k))
    return out


FLOW = [
    "granger_f_a_to_b", "granger_p_a_to_b", "granger_f_b_to_a", "granger_p_b_to_a", "transfer_entropy_a_to_b", "transfer_entropy_b_to_a", "dtw_distance", "mutual_info", "normalized_mi", "kl_divergence_a_to_b", "kl_divergence_b_to_a", "js_divergence",
    "is_cointegrated", "hedge_ratio", "half_life", "spread_zscore", "kendall_tau", "spearman_rho", "lower_tail_dependence", "upper_tail_dependence", "tail_asymmetry",
]


def pair_flow(x: np.ndarray, y: np.ndarray, least: int = 100) -> dict:
    """All dependence measures of two aligned series."""
    out = dict.fromkeys(FLOW, K.NAN) | {"copula_best_family": None}
    if len(x) < least:
        return out
    mi, hx, hy = K.mutual_information(x, y, 10)
    edges = np.histogram_bin_edges(np.concatenate([x, y]), 20)
    p, q = (np.histogram(v, edges)[0] / len(v) for v in (x, y))
    kl = lambda a, b: float(np.where(a > 0, a * np.log((a + 1e-10) / (b + 1e-10)), 0).sum())
    z = lambda v: (v - v.mean()) / v.std() if v.std() > 1e-12 else v * 0
    c, co = cointegration(x, y), copula(x, y)
    (fab, pab), (fba, pba) = granger(x, y), granger(y, x)
    out.update(
        granger_f_a_to_b=fab, granger_p_a_to_b=pab, granger_f_b_to_a=fba, granger_p_b_to_a=pba, transfer_entropy_a_to_b=transfer_entropy(x, y), transfer_entropy_b_to_a=transfer_entropy(y, x), dtw_distance=dtw(z(x), z(y)), mutual_info=mi, normalized_mi=mi / np.sqrt(hx * hy) if hx * hy > 1e-15 else 0.0,
        kl_divergence_a_to_b=kl(p, q), kl_divergence_b_to_a=kl(q, p), js_divergence=0.5 * kl(p, (p + q) / 2) + 0.5 * kl(q, (p + q) / 2), **{k: c[k] for k in ("is_cointegrated", "hedge_ratio", "half_life", "spread_zscore")}, **co,
    )
    return out


def information_flow(obs: DataFrame, flagged: DataFrame | None = None, least: int = 100, most: int = 2000, names: tuple[str, str] = ("signal_a", "signal_b"), keys: tuple[str, ...] = ("cohort",)) -> DataFrame:
    """Dependence of pairs of series over their last ``most`` common points.  ``flagged``
    (cohort, signal_a, signal_b) keeps pairs before any of their points meet."""
    pairs = aligned(obs, flagged)
    w = Window.partitionBy(*PAIR).orderBy(F.desc("signal_0"))
    last = pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    made = last.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("signal_0", "x", "y"))).alias("p"))
    made = spread(made.select(*PAIR, F.transform("p", lambda v: v["x"]).alias("x"), F.transform("p", lambda v: v["y"]).alias("y")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, s, t, x, y in b[[*PAIR, "x", "y"]].itertuples(index=False):
                f = pair_flow(np.asarray(x, float), np.asarray(y, float), least)
                rows.append([c, s, t, len(x), *[f[k] for k in FLOW], f["copula_best_family"]])
            yield pd.DataFrame(rows, columns=[*PAIR, "n_samples", *FLOW, "copula_best_family"])

    out = made.mapInPandas(run, "cohort string, signal_a string, signal_b string, n_samples long, " + ", ".join(f"{c} double" for c in FLOW) + ", copula_best_family string")
    missing = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) if c != "half_life" else F.nanvl(c, F.lit(None))
    flag = F.when(F.isnan("is_cointegrated"), None).otherwise(F.col("is_cointegrated") > 0.5)
    drop_cohort = [] if "cohort" not in keys else [F.col("cohort")]
    return out.select(*drop_cohort, F.col("signal_a").alias(names[0]), F.col("signal_b").alias(names[1]), "n_samples", *[flag.alias(c) if c == "is_cointegrated" else missing(c).alias(c) for c in FLOW], "copula_best_family")
