"""Kernels against analytic truths."""

import tracemalloc

import numpy as np
import pytest

from orrery.functions import kernels as K
from orrery.operators import local
from orrery.operators import pairwise as P
from orrery.operators.dynamics import persistence_summary
from orrery.operators.features import window_metrics
from orrery.operators.fleet import adjacent_pairs, cut, silhouette, ward
from orrery.operators.geometry import spectrum_of
from orrery.operators.local import nearest, saddles, sensitivity


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(42)


@pytest.fixture(scope="module")
def sine():
    return np.sin(2 * np.pi * 10 * np.linspace(0, 1, 1000, endpoint=False))


def test_spectrum_of_a_sine(sine, rng):
    s = K.spectrum(sine, 1000.0)
    assert 9 <= s["dominant_freq"] <= 11 and 9 <= s["fundamental_freq"] <= 11
    noise = K.spectrum(rng.normal(size=1000))
    assert s["spectral_entropy"] < noise["spectral_entropy"] <= 1
    assert 0 <= s["spectral_flatness"] < noise["spectral_flatness"] <= 1
    assert noise["band_low_rel"] + noise["band_mid_rel"] + noise["band_high_rel"] >= 0.999
    assert K.spectrum(np.ones(64))["dominant_freq"] == 0


def test_moments_of_a_sine(sine):
    assert abs(K.shape(sine)["crest_factor"] - np.sqrt(2)) < 0.02 and abs(K.size(sine)["rms"] - 1 / np.sqrt(2)) < 0.01
    assert abs(K.shape(sine)["kurtosis"] + 1.5) < 0.01 and abs(K.acf(sine, 3)[0] - 1) < 1e-12
    assert np.isnan(K.shape(np.ones(10))["kurtosis"])


def test_entropies(rng, sine):
    noise = rng.normal(size=300)
    assert 0 <= K.permutation_entropy(sine) < K.permutation_entropy(noise) <= 1
    assert 0 <= K.sample_entropy(sine[:300]) < K.sample_entropy(noise)
    assert K.permutation_entropy(np.arange(50.0)) == 0


def test_long_memory(rng):
    noise = rng.normal(size=2000)
    assert 0.3 < K.rescaled_range(noise)["hurst"] < 0.75 and K.rescaled_range(np.cumsum(noise))["hurst"] > 0.85
    assert abs(K.dfa(noise) - 0.5) < 0.15 and K.dfa(np.cumsum(noise)) > 1.2


def test_trends(rng):
    y = 3 + 0.5 * np.arange(100)
    assert abs(K.trend(y)["trend_slope"] - 0.5) < 1e-12 and K.trend(y)["trend_r2"] > 0.999
    assert abs(K.mann_kendall(y)["mk_slope"] - 0.5) < 1e-12 and K.mann_kendall(y)["mk_pvalue"] < 1e-6
    walk = np.cumsum(rng.normal(size=500))
    assert abs(K.variance_ratio(walk)["variance_ratio"] - 1) < 0.2
    assert K.adf(rng.normal(size=300))["adf_pvalue"] < 0.01 < K.adf(walk)["adf_pvalue"]
    assert K.adf(np.ones(50))["adf_stat"] == -np.inf


def test_chaos_and_order(sine):
    x = np.empty(800)
    x[0] = 0.4
    for i in range(799):
        x[i + 1] = 4 * x[i] * (1 - x[i])
    assert K.lyapunov_rosenstein(x, 2, 1)[0] > 0.1
    assert K.lyapunov_rosenstein(sine[:600], 2, 25)[0] < 0.05
    r = K.rqa(K.recurrence(K.embed(sine[:200], 3, 5), 0.2))
    assert 0 <= r["recurrence_rate"] <= 1 and r["determinism"] > 0.9


def test_lof_and_cycles():
    y = np.append(np.sin(np.arange(60.0)), 50.0)
    assert K.lof(y)["lof_max"] > 5
    assert K.cycles(np.array([0.0, 1, 0, 1, 0]))["n_cycles"] == 2


def test_discrete():
    d = K.discrete(np.array([1.0, 1, 2, 2, 2, 1, 1, 1]))
    assert d["n_levels"] == 2 and d["transition_count"] == 2 and d["n_dwells"] == 3 and d["dwell_max"] == 3
    assert abs(d["shannon_entropy"] - K.discrete(np.array([1.0, 1, 1, 1, 1, 2, 2, 2]))["shannon_entropy"]) < 1e-12


def test_distributions():
    assert abs(K.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-6 and abs(K.t_quantile(0.975, 10) - 2.2281) < 1e-3
    assert abs(K.f_tail(3, 2, 20) - 0.07254) < 1e-4 and abs(float(K.normal_quantile(0.975)) - 1.95996) < 1e-4


def test_engines_never_fail():
    for y in (np.zeros(0), np.zeros(200), np.full(200, np.nan), np.array([1.0]), np.array([np.inf, 1, 2, 3, 4])):
        out = K.engine_outputs(y, {k: v[1] for k, v in K.ENGINES.items()})
        assert set(out) == {c for v in K.ENGINES.values() for c in v[3]}


def test_pairs(rng):
    x = rng.normal(size=400)
    y = np.roll(x, 1) * 0.8 + 0.2 * rng.normal(size=400)
    f = P.pair_flow(x, y)
    assert f["granger_p_a_to_b"] < 1e-6 < f["granger_p_b_to_a"] and f["transfer_entropy_a_to_b"] > f["transfer_entropy_b_to_a"]
    assert P.dtw(x, x) == 0 and P.dtw(np.array([0.0, 1, 2]), np.array([0.0, 0, 1, 2])) == 0
    brute = np.full((6, 5), np.inf)
    a, b = x[:5], y[:4]
    brute[0, 0] = 0
    for i in range(5):
        for j in range(4):
            brute[i + 1, j + 1] = abs(a[i] - b[j]) + min(brute[i, j], brute[i, j + 1], brute[i + 1, j])
    assert abs(P.dtw(a, b) - brute[5, 4]) < 1e-12
    walk = np.cumsum(rng.normal(size=400))
    c = P.cointegration(2 * walk + rng.normal(size=400) * 0.3, walk)
    assert c["is_cointegrated"] == 1 and abs(c["hedge_ratio"] - 2) < 0.1
    assert abs(P.kendall(x, x) - 1) < 1e-12 and P.copula(x, x + 0.5 * rng.normal(size=400))["kendall_tau"] > 0.5


def test_warping_takes_whole_series():
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(2, 700)).cumsum(1)
    y[:100] += 50  # only seen by who looks at more than the tail
    a, b = ((v - v.mean()) / v.std() for v in (x, y))
    table = np.full((701, 701), np.inf)
    table[0, 0] = 0
    for i in range(700):
        for j in range(700):
            table[i + 1, j + 1] = abs(a[i] - b[j]) + min(table[i, j], table[i, j + 1], table[i + 1, j])
    assert abs(P.pair_flow(x, y)["dtw_distance"] - table[700, 700]) < 1e-6


def test_geometry_kernels(rng):
    s, vecs = spectrum_of(np.diag([3.0, 1.0, 0.5]))
    assert s["eigenvalue_1"] == 3 and 1 <= s["effective_dim"] <= 3 and abs(s["condition_number"] - 6) < 1e-9 and vecs[0, 0] == 1
    m = window_metrics(np.vstack([np.sin(np.arange(50) / 5)] * 3) + 1e-3 * rng.normal(size=(3, 50)))
    assert m["effective_dim"] < 1.01 and m["mean_abs_correlation"] > 0.99


def test_topology():
    t = np.linspace(0, 2 * np.pi, 14, endpoint=False)
    ring = persistence_summary(np.stack([np.cos(t), np.sin(t)], 1))
    assert ring["max_persistence_1"] > 0.5
    assert persistence_summary(np.arange(10.0)[:, None] * [[1, 0]])["max_persistence_1"] == 0


def test_clusters():
    x = np.array([0, 0.1, 0.2, 5, 5.1, 5.2, 9.0])[:, None]
    d = np.abs(x - x.T)
    label = cut(ward(d), 7, 3)
    assert label.tolist() == [0, 0, 0, 1, 1, 1, 2] and silhouette(d, label)[:6].min() > 0.9
    assert (0, 1) in adjacent_pairs(np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [5, 5, 5], [6, 5, 5]]))


def test_local(rng):
    t = np.linspace(0, 2, 80)
    x = np.stack([np.exp(-t), 0.01 * np.exp(t)], 1)
    assert saddles(x)["saddle_score_max"] > 0.1
    f = sensitivity(rng.normal(size=(60, 3)).cumsum(0))
    assert np.allclose(f["share"].sum(1), 1) and f["influence"].shape == (3, 3)


@pytest.mark.parametrize("states", [lambda rng, n: rng.normal(size=(n, 3)), lambda rng, n: rng.integers(0, 3, (n, 3)).astype(float), lambda rng, n: np.ones((n, 3))])
def test_recurrence_of_states_in_blocks(states, monkeypatch):
    """As of the whole matrix, also where many distances are equal."""
    for n in (1, 2, 3, 15, 120):
        x = states(np.random.default_rng(n), n)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        want = K.rqa(d <= np.percentile(d, 10) + 1e-9)
        for cells in (40, 500_000):
            monkeypatch.setattr(K, "CELLS", cells)
            got = K.recurrence_of_states(x, 0.1)
            assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_recurrence_memory():
    """Of 4000 states a matrix has 128 MB."""
    x = np.random.default_rng(1).normal(size=(4000, 3))
    tracemalloc.start()
    K.recurrence_of_states(x, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


@pytest.mark.parametrize("cells", [700, 500_000])
@pytest.mark.parametrize("n,d", [(3, 3), (40, 2), (300, 1), (1500, 3), (700, 5)])
def test_nearest_as_by_sorting(n, d, cells, monkeypatch):
    """Ties by place too, and whatever number of points are equal."""
    monkeypatch.setattr(local, "CELLS", cells)
    rng = np.random.default_rng(n)
    for p in (rng.normal(size=(n, d)), rng.integers(0, 5, (n, d)).astype(float), np.tile(rng.normal(size=(max(1, n // 20), d)), (40, 1))[:n], np.ones((n, d))):
        k = min(10, n)
        first, near, of = nearest(p, k)
        want = np.argsort(((p[:, None] - p[None]) ** 2).sum(2), axis=1, kind="stable")[:, :k]
        assert (p[first][of] == p).all() and (near[of] == want).all()


def test_nearest_looks_at_few_points(monkeypatch):
    """Distances in proportion to the points, not to their square."""
    seen, plain = [], K.squares
    monkeypatch.setattr(K, "squares", lambda q, p: seen.append(q[..., 0].size * p[..., 0].size) or plain(q, p))
    nearest(np.random.default_rng(2).normal(size=(20_000, 3)), 10)
    assert sum(seen) < 20_000**2 / 10


def test_levels_on_an_edge():
    """0.43 and 181.93: the edge above the third bin is 54.88, which belongs to that bin."""
    y = np.array([0.43, 181.93, 54.88, 54.89, 1.0, 30.0, 60.0, 80.0, 100.0, 120.0, 140.0, 160.0])
    assert K.level_labels(y)[[0, 1, 2, 3]].tolist() == [0, 10, 3, 4]


@pytest.mark.parametrize("value", [1.0, 1.37, 7.58, 30.02])
def test_equal_values_have_no_power(value):
    """Nor where their mean is rounded to another number, as that of 64 times 30.02."""
    s = K.spectrum(np.full(64, value))
    assert s["total_power"] == s["signal_power"] == s["snr_linear"] == 0
    assert np.isnan(s["snr_db"]) and np.isnan(s["spectral_flatness"])
