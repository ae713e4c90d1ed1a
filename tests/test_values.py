"""Queries that SQL cannot express, against plain loops over the same inputs."""

import numpy as np
import pytest

from orrery import queries as Q
from orrery.functions import kernels as K
from orrery.operators import dynamics as D
from orrery.operators import fleet as L
from orrery.operators import local as LO
from orrery.operators import pairwise as P


@pytest.fixture(scope="module")
def large(sf_dir):
    return sf_dir.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def series(spark, large):
    """(cohort, signal) -> values, of the events."""
    rows = Q.obs_events(spark, large).toPandas().sort_values("signal_0")
    return {k: g["value"].to_numpy() for k, g in rows.groupby(["cohort", "signal_id"])}


def delay_by_loops(y):
    ami = []
    for k in range(1, min(20, len(y) // 4) + 1):
        h, _, _ = np.histogram2d(y[:-k], y[k:], 16)
        p = h / h.sum()
        ami.append(sum(p[i, j] * np.log(p[i, j] / (p[i].sum() * p[:, j].sum())) for i in range(16) for j in range(16) if p[i, j] > 0))
    for k in range(1, len(ami) - 1):
        if ami[k] < ami[k - 1] - 1e-12 and ami[k] <= ami[k + 1] + 1e-12:
            return k + 1
    d = y - y.mean()
    low = [k for k in range(len(ami) + 1) if (d[: len(d) - k] * d[k:]).sum() / (d * d).sum() < 1 / np.e]
    return max(1, low[0]) if low else 1


def dimension_by_loops(y, delay):
    """Cao's method: how much farther the nearest neighbours are in one more dimension."""
    means, e1 = [], []
    for d in range(1, 12):
        n = len(y) - d * delay
        x = np.array([[y[i + k * delay] for k in range(d + 1)] for i in range(n)])
        ratio = []
        for i in range(n):
            gap = np.abs(x[:, :d] - x[i, :d]).max(1)
            gap[i] = np.inf
            gap[gap < 1e-12] = np.inf
            j = int(gap.argmin())
            ratio.append(np.abs(x[i] - x[j]).max() / gap[j])
        means.append(np.mean(ratio))
        if d > 1:
            e1.append(means[-1] / means[-2])
            if len(e1) > 1 and abs(e1[-1] - e1[-2]) < 0.05:
                return len(e1)
    return 10


def exponent_by_loops(y, dim, delay, kantz=False):
    n = len(y) - (dim - 1) * delay
    x = np.array([[y[i + k * delay] for k in range(dim)] for i in range(n)])
    steps = min(n // 4, 50)
    near = []
    for i in range(n - steps):
        gap = np.array([np.sqrt(((x[i] - x[j]) ** 2).sum()) for j in range(n - steps)])
        gap[[j for j in range(n - steps) if abs(i - j) <= dim * delay]] = np.inf
        gap[gap < 1e-12] = np.inf
        if kantz:
            near.append((i, np.flatnonzero(gap <= 0.1 * y.std() * np.sqrt(dim))))
        elif np.isfinite(gap.min()):
            near.append((i, np.array([gap.argmin()])))
    near = [(i, js) for i, js in near if len(js)]
    div = []
    for k in range(steps):
        gaps = [np.mean([np.sqrt(((x[i + k] - x[j + k]) ** 2).sum()) for j in js]) for i, js in near]
        div.append(np.mean([np.log(g) for g in gaps if g > 1e-12]))
    first = max(3, steps // 3)
    return np.polyfit(np.arange(first), div[:first], 1)[0], np.array(div)


def test_exponents(spark, large, series):
    """ftle (both directions) and the exponents at a fixed dimension, of three signals."""
    some = sorted(series)[:3]
    obs = Q.obs_events(spark, large).where(" or ".join(f"(cohort = '{c}' and signal_id = '{s}')" for c, s in some))
    both = {(r["cohort"], r["signal_id"], r["direction"]): r for r in D.ftle_bidirectional(obs).collect()}
    fixed = {m: {(r["cohort"], r["signal_id"]): r for r in D.lyapunov(obs, method=m).collect()} for m in ("rosenstein", "kantz")}
    assert len(both) == 6
    for key in some:
        for direction, y in (("forward", series[key]), ("backward", series[key][::-1])):
            delay = delay_by_loops(y)
            dim = dimension_by_loops(y, delay)
            value, div = exponent_by_loops(y, dim, delay)
            r = both[(*key, direction)]
            assert (r["embedding_tau"], r["embedding_dim"], r["n_samples"]) == (delay, dim, len(y))
            assert abs(r["ftle"] - value) < 1e-8 and abs(r["ftle_std"] - div.std()) < 1e-8
        y, delay = series[key], delay_by_loops(series[key])
        assert abs(fixed["rosenstein"][key]["lyapunov"] - exponent_by_loops(y, 3, delay)[0]) < 1e-8
        assert abs(fixed["kantz"][key]["lyapunov"] - exponent_by_loops(y, 3, delay, True)[0]) < 1e-8


def test_rolling_exponents(spark, large, series):
    key = sorted(series)[0]
    obs = Q.obs_events(spark, large).where(f"cohort = '{key[0]}' and signal_id = '{key[1]}'")
    got = sorted(D.lyapunov_rolling(obs, 100, 50).collect(), key=lambda r: r["window_id"])
    y = series[key]
    assert len(got) == (len(y) - 100) // 50 + 1
    for r in got:
        own = y[50 * r["window_id"] : 50 * r["window_id"] + 100]
        assert abs(r["lyapunov"] - exponent_by_loops(own, 3, delay_by_loops(own))[0]) < 1e-8


def jacobian_by_loops(x, i, k):
    p, v = x[:-1], np.diff(x, axis=0)
    near = sorted(range(len(p)), key=lambda j: (((p[j] - p[i]) ** 2).sum(), j))[:k]
    m, *_ = np.linalg.lstsq(np.array([p[j] - p[i] for j in near]), np.array([v[j] - v[i] for j in near]), rcond=1e-6)
    return m.T


def test_saddles_of_joint_states(spark, large):
    states, columns = Q._states(spark, large)
    got = {r["cohort"]: r for r in LO.saddle_multivariate(states, columns).collect()}
    for cohort, g in states.toPandas().sort_values("signal_0_end").groupby("cohort"):
        x = g[columns].dropna().to_numpy()
        v = np.diff(x, axis=0)
        speed = np.sqrt((v**2).sum(1))
        score, basin = [], []
        for i in range(len(v)):
            e = np.linalg.eigvals(jacobian_by_loops(x, i, 7)).real
            up, down = e[e > 0].sum(), -e[e < 0].sum()
            score.append(2 * min(up, down) / (up + down + 1e-12) / (1 + speed[i] / (np.median(speed) + 1e-12)))
            basin.append(down / (up + down + 1e-12))
        assert abs(got[cohort]["saddle_score_mean"] - np.mean(score)) < 1e-6 and abs(got[cohort]["saddle_score_max"] - max(score)) < 1e-6 and abs(got[cohort]["basin_stability_mean"] - np.mean(basin)) < 1e-6


def test_sensitivity_of_a_vector(spark, large):
    from orrery.operators.signal_vector import window_features

    obs = Q.obs_events(spark, large)
    signals = Q.signal_ids(obs)
    features = window_features(obs, 32, 8)
    got = LO.sensitivity_of_vector(features, "std", signals).where("cohort = '1' and window_id = 0").collect()
    wide = features.where("cohort = '1'").toPandas().pivot_table(index="signal_0_end", columns="signal_id", values="std").reindex(columns=signals).fillna(0.0).sort_index().to_numpy()[:20]
    x = (wide - wide.mean(0)) / wide.std(0)
    maps = [np.eye(5) + jacobian_by_loops(x, i, 10) for i in range(19)]
    for k, s in enumerate(signals):
        grown = []
        for i in range(19):
            m = np.eye(5)
            for j in range(i, min(i + 5, 19)):
                m = maps[j] @ m
            grown.append(np.sqrt((m[:, k] ** 2).sum()))
        row = next(r for r in got if r["signal_id"] == s)
        assert abs(row["current_sensitivity"] - grown[-1]) < 1e-6 and abs(row["mean_sensitivity"] - np.mean(grown)) < 1e-5 * np.mean(grown)


def warped(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            d[i + 1, j + 1] = abs(x[i] - y[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_causality_and_warping(spark, large):
    """Of two pairs: regressions by normal equations, warping by its table."""
    rows = Q.obs_items(spark, large).where("cohort = 'A_0' and signal_0 < 300 and signal_id in ('p', 'q', 't')")
    got = {(r["signal_a"], r["signal_b"]): r for r in P.information_flow(rows).collect()}
    wide = rows.toPandas().pivot(index="signal_0", columns="signal_id", values="value").sort_index()

    def f_of(source, target):
        y = target[5:]
        own = [np.ones(len(y)), *[target[5 - k : -k] for k in range(1, 6)]]
        ssr = []
        for x in (own, [*own, *[source[5 - k : -k] for k in range(1, 6)]]):
            x = np.array(x).T
            ssr.append(((y - x @ np.linalg.solve(x.T @ x, x.T @ y)) ** 2).sum())
        return (ssr[0] - ssr[1]) / 5 / (ssr[1] / (len(y) - 11))

    for (a, b), r in got.items():
        x, y = wide[a].to_numpy(), wide[b].to_numpy()
        assert abs(r["granger_f_a_to_b"] - f_of(x, y)) < 1e-6 and abs(r["granger_f_b_to_a"] - f_of(y, x)) < 1e-6
        assert abs(r["dtw_distance"] - warped((x - x.mean()) / x.std(), (y - y.mean()) / y.std())) < 1e-8


def test_gated_flow_is_the_flow_of_flagged_pairs(spark, large):
    obs = Q.obs_items(spark, large).where("cohort in ('A_0', 'N_1') and signal_0 < 400")
    flagged = spark.createDataFrame([("A_0", "d", "t"), ("N_1", "p", "q"), ("N_1", "q", "p"), ("none", "d", "t")], "cohort string, signal_a string, signal_b string")
    whole = {(r["cohort"], r["signal_a"], r["signal_b"]): r for r in P.information_flow(obs).collect()}
    some = {(r["cohort"], r["signal_a"], r["signal_b"]): r for r in P.information_flow(obs, flagged).collect()}
    assert set(some) == {("A_0", "d", "t"), ("N_1", "p", "q")} and all(whole[k] == v for k, v in some.items())


def test_trajectory_distances_in_blocks(spark, large):
    """Of all pairs of cohorts, whatever the blocks; and each cohort is in its medoid's cluster."""
    signatures = Q._signatures(spark, large).cache()
    one, two = ({(r["a"], r["b"]): r["distance"] for r in L.signature_distances(signatures, block=b).collect()} for b in (32, 3))
    rows = signatures.toPandas().sort_values("signal_0_end")
    scale = rows[L.SIGNATURE].std(ddof=0)
    own = {c: (g[L.SIGNATURE].fillna(0) / scale).to_numpy() for c, g in rows.groupby("cohort")}
    size = int(np.median([len(x) for x in own.values()]))
    own = {c: np.array([np.interp(np.linspace(0, len(x) - 1, size), np.arange(len(x)), x[:, k]) for k in range(x.shape[1])]) for c, x in own.items()}
    names = sorted(own)
    want = {(a, b): np.mean([warped(p, q) for p, q in zip(own[a], own[b], strict=True)]) / size for i, a in enumerate(names) for b in names[i + 1 :]}
    assert set(one) == set(two) == set(want) and all(abs(one[k] - want[k]) < 1e-9 and abs(two[k] - want[k]) < 1e-9 for k in want)
    made = L.trajectory_library(signatures)
    clusters = {r["trajectory_id"]: r for r in made["library"].collect()}
    for r in made["match"].collect():
        gap = {k: 0.0 if r["cohort"] == c["medoid_cohort"] else want[tuple(sorted((r["cohort"], c["medoid_cohort"])))] for k, c in clusters.items()}
        assert r["trajectory_id"] == min(gap, key=lambda k: (gap[k], k)) and abs(r["match_distance"] - min(gap.values())) < 1e-9


def test_concordance_by_merging():
    rng = np.random.default_rng(3)
    for y in (rng.normal(size=1500), rng.integers(0, 9, 777), np.arange(600.0), np.zeros(5), np.zeros(0)):
        pairs = [(i, j) for i in range(len(y)) for j in range(i + 1, len(y))]
        assert K.concordance(y) == (sum(y[i] < y[j] for i, j in pairs), sum(y[i] > y[j] for i, j in pairs))


def test_trend_of_a_long_signal(spark):
    """200,000 windows of one signal: all pairs would be 2e10 rows."""
    rows = spark.range(200_000).selectExpr("'a' as cohort", "'s' as signal_id", "id as window_id", "cast(id + (id * 7919) % 50000 as double) as v")
    r = D.kendall_trend(rows, "v").collect()
    assert len(r) == 1 and 0.5 < r[0]["tau_v"] < 1


def test_topology_against_matrix_reduction(spark):
    """Lifetimes of components and loops by reducing the whole boundary matrix."""
    rng = np.random.default_rng(8)
    for n in (5, 9, 12):
        x = rng.normal(size=(n, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        simplices = [((i,), 0.0) for i in range(n)] + [((i, j), d[i, j]) for i in range(n) for j in range(i + 1, n)]
        simplices += [((i, j, k), max(d[i, j], d[j, k], d[i, k])) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]
        simplices.sort(key=lambda s: (s[1], len(s[0]), s[0]))
        at = {s: i for i, (s, _) in enumerate(simplices)}
        m = np.zeros((len(simplices),) * 2, bool)
        for s, i in at.items():
            for v in s if len(s) > 1 else ():
                m[at[tuple(w for w in s if w != v)], i] = True
        low, life = {}, {0: [], 1: []}
        for c in range(len(simplices)):
            while m[:, c].any() and (p := int(np.flatnonzero(m[:, c])[-1])) in low:
                m[:, c] ^= m[:, low[p]]
            if m[:, c].any():
                p = int(np.flatnonzero(m[:, c])[-1])
                low[p] = c
                span, k = simplices[c][1] - simplices[p][1], len(simplices[p][0]) - 1
                if span > 1e-12 and k in life:
                    life[k].append(span)
        got = D.persistence_summary(x)
        for k in (0, 1):
            assert abs(got[f"total_persistence_{k}"] - sum(life[k])) < 1e-9 and abs(got[f"max_persistence_{k}"] - max(life[k], default=0)) < 1e-9
