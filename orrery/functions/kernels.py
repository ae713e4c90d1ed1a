"""Numpy kernels over one window.  No Spark in here.

Every kernel takes finite values and returns a dict of floats with fixed names; what is
undefined is NaN.  Shared work (periodogram, analytic signal) is done once by
``engine_outputs`` for all engines of a window."""

from __future__ import annotations

from math import factorial, lgamma
from statistics import NormalDist

import numpy as np

NAN = float("nan")
_STANDARD = NormalDist()
TINY = 1e-15


def clean(y) -> np.ndarray:
    y = np.asarray(y, float)
    return y[np.isfinite(y)]


# ---- moments and correlation ---------------------------------------------------------


def shape(y: np.ndarray) -> dict[str, float]:
    out = {"kurtosis": NAN, "skewness": NAN, "crest_factor": NAN}
    if len(y) >= 3:
        d = y - y.mean()
        m2 = (d * d).mean()
        if m2 > TINY:
            out["skewness"] = (d**3).mean() / m2**1.5
            if len(y) >= 4:
                out["kurtosis"] = (d**4).mean() / m2**2 - 3
    if len(y) >= 4 and (r := np.sqrt((y * y).mean())) > TINY:
        out["crest_factor"] = np.abs(y).max() / r
    return out


def size(y: np.ndarray) -> dict[str, float]:
    if not len(y):
        return {"rms": NAN, "peak": NAN, "peak_to_peak": NAN}
    return {"rms": float(np.sqrt((y * y).mean())), "peak": float(np.abs(y).max()), "peak_to_peak": float(np.ptp(y))}


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and r2 of least squares."""
    if len(x) < 2:
        return NAN, NAN, NAN
    dx, dy = x - x.mean(), y - y.mean()
    sxx, syy = dx @ dx, dy @ dy
    if sxx <= 0:
        return NAN, NAN, NAN
    slope = dx @ dy / sxx
    return float(slope), float(y.mean() - slope * x.mean()), float(slope * slope * sxx / syy) if syy > TINY else 0.0


def trend(y: np.ndarray) -> dict[str, float]:
    if len(y) < 3:
        return dict.fromkeys(("trend_slope", "trend_r2", "detrend_std", "cusum_range"), NAN)
    x = np.arange(len(y), dtype=float)
    slope, base, r2 = line(x, y)
    c = np.cumsum(y - y.mean())
    return {"trend_slope": slope, "trend_r2": r2, "detrend_std": float((y - base - slope * x).std()), "cusum_range": float(np.ptp(c))}


def mann_kendall(y: np.ndarray) -> dict[str, float]:
    n = len(y)
    if n < 10:
        return {"mk_stat": NAN, "mk_pvalue": NAN, "mk_slope": NAN}
    i, j = np.triu_indices(n, 1)
    d = y[j] - y[i]
    s = np.sign(d).sum()
    _, ties = np.unique(y, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
    z = 0.0 if s == 0 or var <= 0 else (s - np.sign(s)) / np.sqrt(var)
    return {"mk_stat": float(z), "mk_pvalue": float(2 * (1 - normal_cdf(abs(z)))), "mk_slope": float(np.median(d / (j - i)))}


def concordance(y: np.ndarray, block: int = 256) -> tuple[int, int]:
    """(rising, falling): pairs of earlier and later values, by merging sorted blocks, in
    n log(n)^2 steps and memory in proportion to n."""
    rising = falling = 0
    blocks = []
    for i in range(0, len(y), block):
        own = y[i : i + block]
        d = np.sign(own[None] - own[:, None])[np.triu_indices(len(own), 1)]
        rising, falling = rising + int((d > 0).sum()), falling + int((d < 0).sum())
        blocks.append(np.sort(own))
    while len(blocks) > 1:
        merged = []
        for a, b in zip(blocks[::2], blocks[1::2], strict=False):
            rising += int(np.searchsorted(a, b, "left").sum())
            falling += int((len(a) - np.searchsorted(a, b, "right")).sum())
            merged.append(np.sort(np.concatenate([a, b]), kind="stable"))
        blocks = merged + ([blocks[-1]] if len(blocks) % 2 else [])
    return rising, falling


def rate_of_change(y: np.ndarray) -> dict[str, float]:
    if len(y) < 3:
        return dict.fromkeys(("mean_rate", "max_rate", "min_rate", "rate_std", "abs_max_rate"), NAN)
    d = np.diff(y)
    return {"mean_rate": float(d.mean()), "max_rate": float(d.max()), "min_rate": float(d.min()), "rate_std": float(d.std()), "abs_max_rate": float(np.abs(d).max())}


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    d = y - y.mean()
    n = len(d)
    f = np.fft.rfft(d, 2 * n)
    full = np.fft.irfft(f * np.conj(f), 2 * n)[: lags + 1]
    return full / full[0] if full[0] > TINY else np.full(lags + 1, NAN)


def memory_decay(y: np.ndarray) -> dict[str, float]:
    out = {"acf_lag1": NAN, "acf_lag10": NAN, "acf_half_life": NAN}
    if len(y) < 4:
        return out
    lags = 50 if len(y) >= 50 else len(y) // 2
    a = acf(y, lags)
    if np.isnan(a[0]):
        return out
    out["acf_lag1"] = float(a[1])
    if lags >= 10:
        out["acf_lag10"] = float(a[10])
    below = np.flatnonzero(a < 0.5)
    if len(below):
        out["acf_half_life"] = float(below[0])
    return out


def variance_ratio(y: np.ndarray) -> dict[str, float]:
    names = ("variance_ratio", "variance_ratio_4", "variance_ratio_8", "variance_ratio_stat")
    if len(y) < 20:
        return dict.fromkeys(names, NAN)
    if y.std() < 1e-10:
        return dict(zip(names, (1.0, 1.0, 1.0, 0.0), strict=True))
    base = np.diff(y).var(ddof=1)
    if base < TINY:
        return dict.fromkeys(names, NAN)
    v = [float((y[q:] - y[:-q]).var(ddof=1) / (q * base)) for q in (2, 4, 8)]
    return dict(zip(names, [*v, (v[0] - 1) / np.sqrt(2 / len(y))], strict=True))


def variance_growth(y: np.ndarray) -> dict[str, float]:
    out = {"variance_growth_rate": NAN, "variance_growth_ratio": NAN}
    n = len(y)
    if n < 20:
        return out
    c = np.cumsum(y - y.mean())
    sizes = [k for k in (n // 8, n // 4, n // 2, n) if k >= 4]
    v = np.array([c[:k].var() for k in sizes])
    good = v > TINY
    if good.sum() >= 2:
        out["variance_growth_rate"] = line(np.log(np.array(sizes)[good]), np.log(v[good]))[0]
    if v[-2] > TINY:
        out["variance_growth_ratio"] = float(v[-1] / v[-2] / 2)
    return out


# ---- long memory and complexity ------------------------------------------------------


def rescaled_range(y: np.ndarray) -> dict[str, float]:
    out, n = {"hurst": NAN, "hurst_r2": NAN}, len(y)
    if n < 10:
        return out
    ks, rs = [], []
    for k in range(10, min(n // 4, 500)):
        m = n // k
        part = y[: m * k].reshape(m, k)
        s = part.std(1, ddof=1)
        c = np.cumsum(part - part.mean(1, keepdims=True), 1)
        good = s > TINY
        if good.any():
            ks.append(k)
            rs.append((np.ptp(c, axis=1)[good] / s[good]).mean())
    if len(ks) >= 3:
        out["hurst"], _, out["hurst_r2"] = line(np.log(ks), np.log(rs))
    return out


def dfa(y: np.ndarray) -> float:
    n = len(y)
    if n < 20 or y.std() < TINY:
        return NAN
    c = np.cumsum(y - y.mean())
    sizes = np.unique(np.geomspace(4, n // 4, 12).astype(int))
    f = []
    for k in sizes:
        m = n // k
        part = c[: m * k].reshape(m, k)
        x = np.arange(k) - (k - 1) / 2
        slope = part @ x / (x @ x)
        res = part - part.mean(1, keepdims=True) - slope[:, None] * x
        f.append(np.sqrt((res**2).mean()))
    f = np.array(f)
    good = f > TINY
    return line(np.log(sizes[good]), np.log(f[good]))[0] if good.sum() >= 3 else NAN


def embed(y: np.ndarray, dim: int, delay: int = 1) -> np.ndarray:
    n = len(y) - (dim - 1) * delay
    return np.stack([y[i * delay : i * delay + n] for i in range(dim)], 1) if n > 0 else np.zeros((0, dim))


def _matches(y: np.ndarray, r: float, m: int) -> list[np.ndarray]:
    """For lengths 1 to ``m``: which templates lie within ``r`` of each other.  Longer ones
    match where shorter ones and the next values do."""
    near = np.abs(y[:, None] - y[None]) <= r
    out = [near]
    for k in range(1, m):
        out.append(out[-1][:-1, :-1] & near[k:, k:])
    return out


def sample_entropy(y: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    if len(y) < m + 2 or y.std() < TINY:
        return NAN
    short, long = _matches(y, share * y.std(), m + 1)[-2:]
    n = len(long)
    a, b = long.sum() - n, short[:n, :n].sum() - n
    return float(-np.log(a / b)) if a > 0 and b > 0 else NAN


def approximate_entropy(y: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    if len(y) < m + 2 or y.std() < TINY:
        return NAN
    phi = [np.log(near.sum(1) / len(near)).mean() for near in _matches(y, share * y.std(), m + 1)[-2:]]
    return float(phi[0] - phi[1])


def permutation_entropy(y: np.ndarray, order: int = 3) -> float:
    if len(y) < order + 1:
        return NAN
    ranks = np.argsort(embed(y, order), axis=1, kind="stable")
    c = np.bincount(ranks @ order ** np.arange(order))
    p = c[c > 0] / c.sum()
    return float(-(p * np.log2(p)).sum() / np.log2(factorial(order)))


# ---- spectrum ------------------------------------------------------------------------


def periodogram(y: np.ndarray, fs: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density, mean removed."""
    n = len(y)
    # equal values have no power; their mean, a rounded sum, can lie beside them
    d = y - y.mean() if y.min() < y.max() else np.zeros(n)
    p = np.abs(np.fft.rfft(d)) ** 2 / (fs * n)
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


SPECTRAL = ("spectral_slope", "dominant_freq", "spectral_entropy", "spectral_centroid", "spectral_bandwidth")
BANDS = ("band_low", "band_mid", "band_high", "band_low_rel", "band_mid_rel", "band_high_rel", "total_power", "nyquist")
FUNDAMENTAL = ("fundamental_freq", "fundamental_power", "fundamental_ratio", "fundamental_amplitude", "harmonic_2x", "harmonic_3x", "thd", "thd_percent", "thd_db", "snr_db", "snr_linear", "signal_power", "noise_power", "spectral_flatness")


def spectrum(y: np.ndarray, fs: float = 1.0) -> dict[str, float]:
    out = dict.fromkeys((*SPECTRAL, *BANDS, *FUNDAMENTAL), NAN)
    n = len(y)
    if n < 4:
        return out
    f, p = periodogram(y, fs)
    total = p.sum()
    out["nyquist"], out["total_power"] = fs / 2, float(total)
    if y.std() < 1e-10:
        out.update(dict.fromkeys(SPECTRAL, 0.0))
    elif total > TINY:
        c = float((f * p).sum() / total)
        q = p[p > 0] / total
        out.update(dominant_freq=float(f[1 + p[1:].argmax()]), spectral_centroid=c, spectral_bandwidth=float(np.sqrt(((f - c) ** 2 * p).sum() / total)), spectral_entropy=float(-(q * np.log(q)).sum() / np.log(len(p))))
    for name, low, high in (("low", 0.0, 0.1), ("mid", 0.1, 0.5), ("high", 0.5, 1.0)):
        own = float(p[(f >= low * fs / 2) & (f <= high * fs / 2)].sum())  # both edges belong to the band
        out[f"band_{name}"], out[f"band_{name}_rel"] = own, own / (total + 1e-10)
    if n < 8:
        return out
    k = 1 + int(p[1:].argmax())
    f0, p0 = float(f[k]), float(p[k])
    near = lambda x: float(p[np.abs(f - x).argmin()]) if x <= f[-1] else 0.0
    h = [near(m * f0) for m in range(2, 6)]
    out.update(fundamental_freq=f0, fundamental_power=p0, fundamental_ratio=p0 / total if total > TINY else NAN, fundamental_amplitude=float(np.sqrt(p0)), harmonic_2x=float(np.sqrt(h[0])), harmonic_3x=float(np.sqrt(h[1])))
    if p0 > TINY:
        d = float(np.sqrt(sum(h) / p0))
        out.update(thd=d, thd_percent=100 * d, thd_db=float(20 * np.log10(d)) if d > 0 else NAN)
    top = np.sort(p)[::-1]
    cut = max(1, n // 10)
    signal, noise = float(top[:cut].sum()), max(float(top[cut:].sum()), 1e-12)
    out.update(signal_power=signal, noise_power=noise, snr_linear=signal / noise, snr_db=float(10 * np.log10(signal / noise)) if signal > 0 else NAN)
    positive = p[p > 0]
    if len(positive):
        out["spectral_flatness"] = float(np.exp(np.log(positive).mean()) / positive.mean())
    return out


def analytic(y: np.ndarray) -> np.ndarray:
    n = len(y)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(y) * h)


HILBERT = ("inst_freq_mean", "inst_freq_std", "inst_freq_stability", "inst_freq_kurtosis", "inst_freq_skewness", "inst_freq_range", "inst_freq_drift", "inst_amp_cv", "inst_amp_trend", "hilbert_phase_coherence", "am_fm_ratio")


def hilbert(y: np.ndarray) -> dict[str, float]:
    out = dict.fromkeys(("envelope_rms", "envelope_peak", "envelope_kurtosis", *HILBERT), NAN)
    if len(y) < 4:
        return out
    z = analytic(y - y.mean())
    amp = np.abs(z)
    out.update(envelope_rms=float(np.sqrt((amp**2).mean())), envelope_peak=float(amp.max()), envelope_kurtosis=shape(amp)["kurtosis"])
    if len(y) < 10 or y.std() < TINY:
        return out
    phase = np.unwrap(np.angle(z))
    freq = np.diff(phase) / (2 * np.pi)
    fm, fs = freq.mean(), freq.std()
    s = shape(freq)
    cv = float(amp.std() / amp.mean()) if amp.mean() > TINY else NAN
    x = np.arange(len(freq), dtype=float)
    out.update(
        inst_freq_mean=float(fm), inst_freq_std=float(fs), inst_freq_stability=float(1 / (1 + fs / (abs(fm) + 1e-10))), inst_freq_kurtosis=s["kurtosis"], inst_freq_skewness=s["skewness"], inst_freq_range=float(np.ptp(freq)),
        inst_freq_drift=line(x, freq)[0], inst_amp_cv=cv, inst_amp_trend=line(np.arange(len(amp), dtype=float), amp)[0], hilbert_phase_coherence=float(np.abs(np.exp(1j * np.diff(phase)).mean())), am_fm_ratio=cv / float(fs / (abs(fm) + 1e-10)) if fs > TINY else NAN,
    )
    return out


def phase_coherence(y: np.ndarray, segments: int = 4) -> dict[str, float]:
    out = {"phase_coherence": NAN, "phase_coherence_std": NAN, "phase_coherence_trend": NAN}
    if len(y) < 16:
        return out
    k = len(y) // segments
    phases = [np.angle(analytic(y[i * k : (i + 1) * k] - y[i * k : (i + 1) * k].mean())) for i in range(segments)]
    c = np.array([np.abs(np.exp(1j * (b - a)).mean()) for a, b in zip(phases, phases[1:], strict=False)])
    return {"phase_coherence": float(c.mean()), "phase_coherence_std": float(c.std()), "phase_coherence_trend": line(np.arange(len(c), dtype=float), c)[0]}


def band_stability(y: np.ndarray) -> dict[str, float]:
    """Energy of the spectrum's thirds and of a rolling window."""
    names = ("wavelet_entropy", "wavelet_concentration", "wavelet_dominant_scale", "wavelet_energy_drift", "wavelet_energy_std", "wavelet_energy_kurtosis")
    out = dict.fromkeys(names, NAN)
    if len(y) < 10:
        return out
    p = np.abs(np.fft.rfft(y - y.mean())) ** 2
    e = np.array([x.sum() for x in np.array_split(p[1:], 3)])
    if e.sum() > TINY:
        q = e / e.sum()
        out.update(wavelet_entropy=float(-(q[q > 0] * np.log(q[q > 0])).sum()), wavelet_concentration=float(q.max()), wavelet_dominant_scale=float(q.argmax()))
    w = max(2, len(y) // 10)
    rolling = np.convolve(y * y, np.ones(w) / w, "valid")
    out.update(wavelet_energy_drift=line(np.arange(len(rolling), dtype=float), rolling)[0], wavelet_energy_std=float(rolling.std()), wavelet_energy_kurtosis=shape(rolling)["kurtosis"])
    return out


# ---- phase space ---------------------------------------------------------------------


def _cells(x: np.ndarray, bins: int) -> np.ndarray:
    """Numbers of equal-width bins; a value on an edge belongs to the bin above, the largest
    to the last one."""
    low, high = x.min(), x.max()
    if high <= low:
        return np.zeros(len(x), np.int64)
    edges = np.linspace(low, high, bins + 1)
    at = np.minimum(((x - low) / (high - low) * bins).astype(np.int64), bins - 1)
    at -= x < edges[at]  # the quotient may be off by its rounding
    return at + ((x >= edges[at + 1]) & (at < bins - 1))


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int) -> tuple[float, float, float]:
    """(MI, H(x), H(y)) in nats from equal-width histograms."""
    h = np.bincount(_cells(x, bins) * bins + _cells(y, bins), minlength=bins * bins).reshape(bins, bins)
    p = h / max(1, len(x))
    ent = lambda q: float(-(q[q > 0] * np.log(q[q > 0])).sum())
    hx, hy = ent(p.sum(1)), ent(p.sum(0))
    return max(0.0, hx + hy - ent(p.ravel())), hx, hy


def optimal_delay(y: np.ndarray, most: int = 20) -> int:
    """First minimum of average mutual information (16 bins), else first lag with an
    autocorrelation under 1/e."""
    most = min(most, len(y) // 4)
    if most < 2 or y.std() < TINY:
        return 1
    ami: list[float] = []
    for k in range(1, most + 1):
        ami.append(mutual_information(y[:-k], y[k:], 16)[0])
        if k > 2 and ami[-2] < ami[-3] and ami[-2] <= ami[-1]:
            return k - 1
    below = np.flatnonzero(acf(y, most) < 1 / np.e)
    return int(max(1, below[0])) if len(below) else 1


def _distances(x: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)
    return np.sqrt(np.maximum(d[:, None] + d[None] - 2 * x @ x.T, 0))


def cao_dimension(y: np.ndarray, delay: int, most: int = 10, points: int = 600) -> int:
    """Where Cao's E1 stops changing.  The distance in d + 1 dimensions is the larger of that
    in d and of the new coordinate's, so that each dimension costs one matrix."""
    means, e1, low, step, d0 = [], [], None, 0, 0
    for d in range(1, most + 2):
        n = len(y) - d * delay
        if n < 10:
            break
        every = max(1, n // points)
        at = np.arange(0, n, every)
        if every != step:  # other points: from the first coordinate on
            low, step, d0 = np.zeros((len(at), len(at))), every, 0
        low = low[: len(at), : len(at)]
        for k in range(d0, d):
            v = y[at + k * delay]
            low = np.maximum(low, np.abs(v[:, None] - v[None]))
        d0 = d
        far = np.where(low < 1e-12, np.inf, low)  # also the points themselves
        near = far.argmin(1)
        base = far[np.arange(len(at)), near]
        good = np.isfinite(base)
        if not good.any():
            break
        full = np.maximum(base, np.abs(y[at + d * delay] - y[at[near] + d * delay]))
        means.append((full[good] / base[good]).mean())
        if len(means) > 1 and means[-2] > 0:
            e1.append(means[-1] / means[-2])
            if len(e1) > 1 and abs(e1[-1] - e1[-2]) < 0.05:
                return len(e1)
    return max(2, min(len(e1) + 1, most)) if e1 else 2


def lyapunov_rosenstein(y: np.ndarray, dim: int, delay: int, points: int = 1200) -> tuple[float, np.ndarray]:
    """Slope of the mean log divergence over its first third, and the divergence."""
    x = embed(y, dim, delay)
    n = len(x)
    if n < 20 or y.std() < TINY:
        return NAN, np.zeros(0)
    steps = min(n // 4, 50)
    d = _distances(x[: n - steps])
    i = np.arange(len(d))
    d[np.abs(i[:, None] - i[None]) <= dim * delay] = np.inf
    d[d < 1e-12] = np.inf
    near = d.argmin(1)
    good = np.isfinite(d[i, near])
    if good.sum() < 5:
        return NAN, np.zeros(0)
    a, b = i[good], near[good]
    div = []
    for k in range(steps):
        gap = np.sqrt(((x[a + k] - x[b + k]) ** 2).sum(1))
        gap = gap[gap > 1e-12]
        div.append(np.log(gap).mean() if len(gap) else NAN)
    div = np.array(div)
    first = max(3, steps // 3)
    t, v = np.arange(first, dtype=float), div[:first]
    ok = np.isfinite(v)
    return (line(t[ok], v[ok])[0] if ok.sum() >= 3 else NAN), div


def lyapunov_kantz(y: np.ndarray, dim: int, delay: int, share: float = 0.1, points: int = 1200) -> tuple[float, np.ndarray]:
    """As above, of the mean distance to all neighbours within ``share`` of the deviation."""
    x = embed(y, dim, delay)
    n = len(x)
    if n < 20 or y.std() < TINY:
        return NAN, np.zeros(0)
    steps = min(n // 4, 50)
    m = min(n - steps, points)
    d = _distances(x[:m])
    i = np.arange(m)
    a, b = np.nonzero((d <= share * y.std() * np.sqrt(dim)) & (d >= 1e-12) & (np.abs(i[:, None] - i[None]) > dim * delay))
    if len(np.unique(a)) < 5:
        return NAN, np.zeros(0)
    own = np.bincount(a, minlength=m)
    div = []
    for k in range(steps):
        mean = np.bincount(a, np.sqrt(((x[a + k] - x[b + k]) ** 2).sum(1)), m)[own > 0] / own[own > 0]
        mean = mean[mean > 1e-12]
        div.append(np.log(mean).mean() if len(mean) else NAN)
    div = np.array(div)
    first = max(3, steps // 3)
    t, v = np.arange(first, dtype=float), div[:first]
    ok = np.isfinite(v)
    return (line(t[ok], v[ok])[0] if ok.sum() >= 3 else NAN), div


def recurrence(x: np.ndarray, epsilon: float) -> np.ndarray:
    return _distances(x) <= epsilon


def _runs(rows: np.ndarray, least: int = 2) -> np.ndarray:
    """Lengths of the runs of 1 within rows, those of at least ``least``."""
    flat = np.zeros((len(rows), rows.shape[1] + 1), np.int8)
    flat[:, :-1] = rows
    edge = np.flatnonzero(np.diff(flat.ravel(), prepend=0, append=0))
    n = edge[1::2] - edge[::2]
    return n[n >= least]


def rqa(r: np.ndarray) -> dict[str, float]:
    n = len(r)
    i, j = np.triu_indices(n, 1)
    above = np.zeros((max(n - 1, 0), n), np.int8)  # a diagonal a row
    above[j - i - 1, i] = r[i, j]
    return _rqa(n, int(r.sum()), np.bincount(_runs(above)), np.bincount(_runs(r)))


def _rqa(n: int, total: int, diag: np.ndarray, vert: np.ndarray) -> dict[str, float]:
    """The measures of how many pairs recur and of the numbers of runs by length."""
    off = (total - n) / 2
    p = diag[diag > 0] / max(diag.sum(), 1)
    along, down = float(diag @ np.arange(len(diag))), float(vert @ np.arange(len(vert)))
    return {
        "recurrence_rate": float(total / n**2), "determinism": along / off if off > 0 else 0.0, "laminarity": down / total if total else 0.0,
        "trapping_time": down / float(vert.sum()) if len(vert) else 0.0, "rqa_entropy": float(-(p * np.log(p)).sum()) if len(p) else 0.0, "longest_diagonal": float(max(len(diag) - 1, 0)),
    }


#: Distances held at once, and those of one rank's bin.
CELLS = 500_000


def squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``q`` from rows of ``p`` (of all pairs, or as they broadcast)."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], p.shape[:-1]))
    for k in range(q.shape[-1]):
        step = q[..., k] - p[..., k]
        out += step * step
    return out


def _diagonals(x: np.ndarray):
    """Squared distances of all pairs i < j, diagonals j - i = 1, 2, ... in blocks of about ``CELLS``."""
    made, held = [], 0
    for k in range(1, len(x)):
        made.append(squares(x[k:], x[:-k]))
        held += len(made[-1])
        if held >= CELLS or k == len(x) - 1:
            yield np.concatenate(made)
            made, held = [], 0


def neighbours_of_rank(blocks, rank: int, after: int) -> tuple[float, float]:
    """The values of rank ``rank`` and ``after`` (the same or the next) among the nonnegative
    numbers that ``blocks()`` yields.  They are found by their bits, highest first, so that
    counts are held instead of the numbers."""
    head, known = 0, 0
    for width in (18, 18, 14, 14):
        rest, counts = 64 - known - width, np.zeros(1 << width, np.int64)

        def own():
            for v in blocks():
                u = v.view(np.uint64)
                if known:
                    v, u = v[u >> (64 - known) == head], u[u >> (64 - known) == head]
                yield v, ((u >> rest) & ((1 << width) - 1)).astype(np.int64)

        for _, cell in own():
            counts += np.bincount(cell, minlength=1 << width)
        ends = counts.cumsum()
        a, b = (int(np.searchsorted(ends, r, "right")) for r in (rank, after))
        if a != b:  # one is the last of its bin, the other the first of the next
            found = [(v[cell == a].max(initial=0.0), v[cell == b].min(initial=np.inf)) for v, cell in own()]
            return float(max(f[0] for f in found)), float(min(f[1] for f in found))
        before = int(ends[a] - counts[a])
        rank, after = rank - before, after - before
        if counts[a] <= CELLS:
            v = np.sort(np.concatenate([v[cell == a] for v, cell in own()]))
            return float(v[rank]), float(v[after])
        head, known = head << width | a, known + width
    value = float(np.uint64(head).view(np.float64))  # so many are equal
    return value, value


def recurrence_of_states(x: np.ndarray, share: float) -> dict[str, float]:
    """``rqa`` of the points that lie within the ``share`` quantile of all distances (of a
    point from itself too), in blocks of pairs: memory grows with the number of points and
    only time with its square.  A distance that equals the quantile but for its rounding recurs."""
    n = len(x)
    at = share * (n * n - 1)
    ranks = [int(np.floor(at)), int(np.ceil(at))]  # n distances of 0, then each pair's twice
    low = high = 0.0
    if ranks[1] >= n:
        a, b = (max(r - n, 0) // 2 for r in ranks)
        low, high = (v**0.5 for v in neighbours_of_rank(lambda: _diagonals(x), a, b))
        low = low if ranks[0] >= n else 0.0
    limit = low + (high - low) * (at - ranks[0]) + 1e-9
    diag, vert, total = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64), 0
    for k in range(1, n):
        diag += np.bincount(_runs((np.sqrt(squares(x[k:], x[:-k])) <= limit)[None]), minlength=n + 2)
    block = max(1, CELLS // n)
    for k in range(0, n, block):
        near = np.sqrt(squares(x[k : k + block, None], x[None])) <= limit
        total += int(near.sum())
        vert += np.bincount(_runs(near), minlength=n + 2)
    return _rqa(n, total, np.trim_zeros(diag, "b"), np.trim_zeros(vert, "b"))


def correlation_dimension(x: np.ndarray) -> float:
    """Slope of log C(r) over log r between the 5th and the 50th percentile of distances."""
    if len(x) < 20:
        return NAN
    d = _distances(x)[np.triu_indices(len(x), 1)]
    d = d[d > 1e-12]
    if len(d) < 20:
        return 0.0
    r = np.geomspace(np.percentile(d, 5), np.percentile(d, 50), 10)
    c = np.array([(d < v).mean() for v in r])
    good = c > 0
    return line(np.log(r[good]), np.log(c[good]))[0] if good.sum() >= 3 and r[-1] > r[0] else NAN


def phase_space(y: np.ndarray) -> dict[str, float]:
    out = dict.fromkeys(("recurrence_rate", "determinism", "correlation_dimension", "embedding_dim", "embedding_delay", "lyapunov", "lyapunov_confidence"), NAN)
    if len(y) < 30:
        return out
    x = embed(y, 3)
    r = rqa(recurrence(x, 0.1 * y.std()))
    delay = optimal_delay(y)
    dim = cao_dimension(y, delay)
    exponent, div = lyapunov_rosenstein(y, dim, delay)
    out.update(recurrence_rate=r["recurrence_rate"], determinism=r["determinism"], correlation_dimension=correlation_dimension(embed(y, 5)), embedding_dim=float(dim), embedding_delay=float(delay), lyapunov=exponent, lyapunov_confidence=min(1.0, len(div) / 100))
    return out


def attractor(y: np.ndarray) -> dict[str, float]:
    """Delay, dimension and recurrence measures of a whole signal, at the distance of the
    10th percentile."""
    names = ("delay", "embedding_dim", "correlation_dim", "recurrence_rate", "determinism", "laminarity", "trapping_time", "rqa_entropy")
    if len(y) < 100:
        return dict.fromkeys(names, NAN)
    delay = optimal_delay(y)
    dim = cao_dimension(y, delay)
    x = embed(y, dim, delay)
    x = x[:: max(1, len(x) // 600)]
    d = _distances(x)
    r = rqa(d <= np.percentile(d, 10))
    return {"delay": float(delay), "embedding_dim": float(dim), "correlation_dim": 0.0 if y.std() < 1e-10 else correlation_dimension(x)} | {k: r[k] for k in names[3:]}


# ---- models --------------------------------------------------------------------------


def dmd(y: np.ndarray) -> dict[str, float]:
    out = {"dmd_dominant_freq": NAN, "dmd_growth_rate": NAN, "dmd_is_stable": NAN, "dmd_n_modes": NAN}
    n = len(y)
    if n < 10:
        return out
    h = np.lib.stride_tricks.sliding_window_view(y - y.mean(), n // 2).T
    a, b = h[:, :-1], h[:, 1:]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    r = int((s > 1e-8 * s[0]).sum()) if s[0] > TINY else 0
    if not r:
        return out
    r = min(r, 10)
    lam = np.linalg.eigvals(u[:, :r].T @ b @ vt[:r].T / s[:r])
    lam = lam[np.abs(lam) > 1e-12]
    if not len(lam):
        return out
    w = np.log(lam)
    k = int(np.abs(lam).argmax())
    return {"dmd_dominant_freq": float(abs(w[k].imag) / (2 * np.pi)), "dmd_growth_rate": float(w.real.max()), "dmd_is_stable": float(np.abs(lam).max() <= 1 + 1e-6), "dmd_n_modes": float(r)}


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    res = y - x @ b
    return b, float(res @ res), res


#: fixed values: MacKinnon (1994) polynomials for the p-value of the test with a constant
MACKINNON_SMALL, MACKINNON_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
MACKINNON_STAR, MACKINNON_MIN, MACKINNON_MAX = -1.61, -18.83, 2.74


def mackinnon_p(stat: float) -> float:
    if not np.isfinite(stat):
        return 0.0 if stat < 0 else 1.0
    if stat > MACKINNON_MAX:
        return 1.0
    if stat < MACKINNON_MIN:
        return 0.0
    c = MACKINNON_SMALL if stat <= MACKINNON_STAR else MACKINNON_LARGE
    return float(normal_cdf(sum(k * stat**i for i, k in enumerate(c))))


def adf(y: np.ndarray, max_lag: int | None = None) -> dict[str, float]:
    """Augmented Dickey-Fuller with a constant; the lag of the least AIC."""
    n = len(y)
    if n < 20:
        return {"adf_stat": NAN, "adf_pvalue": NAN, "adf_lags": NAN, "adf_nobs": NAN}
    if y.std() < 1e-10:
        return {"adf_stat": -np.inf, "adf_pvalue": 0.0, "adf_lags": 0.0, "adf_nobs": float(n)}
    most = min(int(12 * (n / 100) ** 0.25), n // 2 - 2) if max_lag is None else max_lag
    d = np.diff(y)
    # the regressions of fewer lags are the first columns of that of most: one factor serves all
    x = np.column_stack([y[most:-1], np.ones(len(d) - most), *[d[most - k : len(d) - k] for k in range(1, most + 1)]])
    t, m = d[most:], len(d) - most
    try:
        z = np.linalg.solve(np.linalg.cholesky(x.T @ x), x.T @ t)
        ssr = (t @ t - np.cumsum(z * z))[1:]
    except np.linalg.LinAlgError:
        ssr = np.array([_ols(x[:, : lag + 2], t)[1] for lag in range(most + 1)])
    lag = int(np.argmin(m * np.log(np.maximum(ssr, TINY) / m) + 2 * (np.arange(most + 1) + 2)))
    x = np.column_stack([y[lag:-1], np.ones(len(d) - lag), *[d[lag - k : len(d) - k] for k in range(1, lag + 1)]])
    b, ssr, _ = _ols(x, d[lag:])
    var = ssr / max(1, len(x) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0]
    stat = float(b[0] / np.sqrt(var)) if var > 0 else NAN
    return {"adf_stat": stat, "adf_pvalue": mackinnon_p(stat) if np.isfinite(stat) else NAN, "adf_lags": float(lag), "adf_nobs": float(len(x))}


def basin(y: np.ndarray, bins: int = 20) -> dict[str, float]:
    if len(y) < 100 or np.ptp(y) < TINY:
        return {"basin_stability": NAN, "transition_prob": NAN, "n_attractors": NAN}
    label = np.minimum(((y - y.min()) / np.ptp(y) * bins).astype(int), bins - 1)
    c = np.bincount(label, minlength=bins)
    return {"basin_stability": float(c.max() / len(y)), "transition_prob": float((label[1:] != label[:-1]).mean()), "n_attractors": float((c > len(y) / bins * 0.5).sum())}


def cycles(y: np.ndarray) -> dict[str, float]:
    """Ranges between turning points as half cycles."""
    names = ("n_cycles", "mean_cycle_range", "max_cycle_range", "cycle_accumulation")
    if len(y) < 4:
        return dict.fromkeys(names, NAN)
    d = np.diff(y)
    d = d[d != 0]
    change = np.flatnonzero(np.sign(d[1:]) != np.sign(d[:-1])) + 1 if len(d) else np.zeros(0, int)
    level = np.concatenate([[0.0], np.cumsum(d)])
    r = np.abs(np.diff(level[np.concatenate([[0], change, [len(d)]])])) if len(d) else np.zeros(0)
    if not len(r):
        return dict(zip(names, (0.0, 0.0, 0.0, 0.0), strict=True))
    return dict(zip(names, (float(len(r) // 2), float(r.mean()), float(r.max()), float(((r / r.max()) ** 3 * 0.5).sum())), strict=True))


def lof(y: np.ndarray, k: int = 20) -> dict[str, float]:
    """Local outlier factors in one dimension: neighbours lie next to each other in
    order, so that a window of 2k + 1 holds them."""
    n = len(y)
    if n < k + 1:
        return {"lof_max": NAN, "lof_mean": NAN, "outlier_fraction": NAN}
    v = np.sort(y)
    at = np.clip(np.arange(n)[:, None] + np.arange(-k, k + 1), 0, n - 1)
    ok = (np.arange(n)[:, None] + np.arange(-k, k + 1) == at) & (at != np.arange(n)[:, None])
    d = np.where(ok, np.abs(v[at] - v[:, None]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near, dist = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
    reach = np.maximum(dist, dist[:, -1][near])
    density = 1 / np.maximum(reach.mean(1), 1e-10)
    score = density[near].mean(1) / density
    return {"lof_max": float(score.max()), "lof_mean": float(score.mean()), "outlier_fraction": float((score > 1.5).mean())}


def time_constant(y: np.ndarray) -> dict[str, float]:
    out = {"tau": NAN, "tau_r2": NAN, "equilibrium_value": NAN, "is_decay": NAN}
    if len(y) < 10:
        return out
    d = np.diff(y)
    up = (d > 0).mean() >= 0.7
    down = (d < 0).mean() >= 0.7
    if not (up or down):
        return out
    slope, _, r2 = line(np.arange(len(y), dtype=float), np.log(y - y.min() + 1e-10))
    return {"tau": abs(1 / slope) if abs(slope) > TINY else NAN, "tau_r2": r2, "equilibrium_value": float(y[-max(1, len(y) // 10) :].mean()), "is_decay": float(down)}


# ---- discrete states -----------------------------------------------------------------


def level_labels(y: np.ndarray, bins: int = 10) -> np.ndarray:
    u, inverse = np.unique(y, return_inverse=True)
    if len(u) <= bins:
        return inverse
    # in this order of steps an edge such as 0.43 + 3 / 10 of 181.5 is the decimal value that lies on it
    edges = u[0] + (u[-1] - u[0]) * np.arange(bins + 1) / bins
    edges[-1] = u[-1]
    return np.digitize(y, edges, right=True)


def discrete(y: np.ndarray, bins: int = 10) -> dict[str, float]:
    names = (
        "shannon_entropy", "normalized_entropy", "conditional_entropy", "excess_entropy", "n_levels", "level_occupancy", "dominant_level", "level_spread", "level_entropy",
        "hist_uniformity", "hist_concentration", "hist_peak_ratio", "hist_tail_weight", "hist_bimodality", "trans_entropy", "trans_self_loop", "trans_max_self_loop", "trans_asymmetry", "trans_n_active", "trans_sparsity",
        "transition_count", "duty_dominant", "duty_secondary", "duty_ratio", "duty_balance", "duty_range", "dwell_mean", "dwell_std", "dwell_max", "dwell_min", "dwell_cv", "n_dwells", "mtb_mean", "mtb_std", "mtb_max", "mtb_min", "mtb_cv",
    )
    if len(y) < 4:
        return dict.fromkeys(names, NAN)
    _, s = np.unique(level_labels(y, bins), return_inverse=True)
    k, n = int(s.max()) + 1, len(s)
    p = np.bincount(s) / n
    t = np.zeros((k, k))
    np.add.at(t, (s[:-1], s[1:]), 1)
    ent = lambda q: float(-(q[q > 0] * np.log2(q[q > 0])).sum())
    h, joint, lone = ent(p), ent(t.ravel() / (n - 1)), ent(t.sum(1) / (n - 1))
    row = t / np.maximum(t.sum(1, keepdims=True), 1)
    order = np.sort(p)[::-1]
    top = max(1.0, np.log2(min(k, bins))) if k > 1 else 1.0
    edges = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    run = np.diff(np.append(edges, n)).astype(float)
    state_edges = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    state_run = np.diff(np.append(state_edges, n)).astype(float)
    per_state = np.array([state_run[s[state_edges] == i].mean() for i in range(k)])
    gini = float(np.clip(np.abs(p[:, None] - p[None]).sum() / (2 * k * k * p.mean()), 0, 1))
    sh = shape(y)
    bimodal = NAN
    if n >= 4 and np.isfinite(sh["kurtosis"]):
        bimodal = (sh["skewness"] ** 2 + 1) / (sh["kurtosis"] + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    cv = lambda v: float(v.std() / v.mean()) if v.mean() > TINY else NAN
    second = float(order[1]) if k > 1 else 0.0
    values = (
        h, h / top if k > 1 else 0.0, max(0.0, joint - lone), h - max(0.0, joint - lone), k, k / n, float(np.bincount(s).argmax()), float(np.std(s)), h / np.log2(k) if k > 1 else 0.0,
        float(1 - np.abs(p - 1 / k).sum() / 2), gini, float(order[0] / p.mean()), float(np.sort(p)[: max(1, k // 5)].sum()), bimodal,
        float(sum(q * ent(r) for q, r in zip(t.sum(1) / (n - 1), row, strict=True))) if k > 1 else 0.0, float(np.trace(t) / (n - 1)) if k > 1 else 1.0, float(np.diag(row).max()) if k > 1 else 1.0, float(np.linalg.norm(row - row.T)) if k > 1 else 0.0, float((t > 0).sum()), float(1 - (t > 0).sum() / k**2) if k > 1 else 1.0,
        float((s[1:] != s[:-1]).sum()), float(order[0]), second, float(order[0] / second) if second > 0 else NAN, float(h / np.log2(k)) if k > 1 else 0.0, float(order[0] - order[-1]), float(run.mean()), float(run.std()), float(run.max()), float(run.min()), cv(run), float(len(run)), float(per_state.mean()), float(per_state.std()), float(per_state.max()), float(per_state.min()), cv(per_state),
    )
    return {a: float(b) for a, b in zip(names, values, strict=True)}


# ---- engines -------------------------------------------------------------------------

#: engine -> (function, window, least observations, outputs)
ENGINES: dict[str, tuple] = {}


_BUILT_IN: dict[str, tuple] = {}


def register(name: str, fn, window: int, least: int) -> None:
    """Add (or replace) an engine: ``fn`` makes a dict of fixed names of a window's values,
    also of none."""
    ENGINES[name] = (fn, window, least, tuple(fn(np.zeros(0))))


def reset_engines() -> None:
    """Only the built-in engines, as they were."""
    ENGINES.clear()
    ENGINES.update(_BUILT_IN)


def _complexity(y: np.ndarray) -> dict[str, float]:
    return {"sample_entropy": sample_entropy(y), "permutation_entropy": permutation_entropy(y), "approximate_entropy": approximate_entropy(y)}


def _memory(y: np.ndarray) -> dict[str, float]:
    return rescaled_range(y) | {"dfa": dfa(y)}


def _pulsation(y: np.ndarray) -> dict[str, float]:
    if len(y) < 10:
        return {"pulsation_index": NAN, "flow_mean": NAN, "flow_range": NAN}
    return {"pulsation_index": float(np.ptp(y) / (abs(y.mean()) + 1e-10)), "flow_mean": float(y.mean()), "flow_range": float(np.ptp(y))}


def _unfitted(*names: str):
    """Outputs that are declared and never fitted: volatility and hidden-state models."""
    return lambda y: dict.fromkeys(names, NAN)


for _name, _fn, _window, _least in (
    ("statistics", shape, 16, 4), ("size", size, 16, 1), ("memory", _memory, 64, 22), ("acf_decay", memory_decay, 48, 4), ("complexity", _complexity, 64, 32),
    ("spectral", spectrum, 64, 32), ("hilbert", hilbert, 32, 10), ("phase_coherence", phase_coherence, 32, 16), ("wavelet_stability", band_stability, 32, 10),
    ("trend", trend, 32, 8), ("mann_kendall", mann_kendall, 32, 10), ("rate_of_change", rate_of_change, 16, 4), ("adf", adf, 64, 20), ("variance_ratio", variance_ratio, 64, 20),
    ("variance_growth", variance_growth, 32, 16), ("phase_space", phase_space, 64, 30), ("attractor", lambda y: {f"attractor_{k}": v for k, v in attractor(y).items()}, 100, 100), ("dmd", dmd, 64, 32), ("basin", basin, 100, 100),
    ("cycle_counting", cycles, 32, 4), ("lof", lof, 32, 21), ("pulsation_index", _pulsation, 16, 10), ("time_constant", time_constant, 16, 10), ("discrete", discrete, 32, 4),
    ("garch", _unfitted("garch_omega", "garch_alpha", "garch_beta", "garch_persistence"), 64, 32), ("hmm", _unfitted("hmm_n_states", "hmm_current_state", "hmm_current_prob", "hmm_state_entropy", "hmm_transition_rate", "hmm_log_likelihood", "hmm_bic"), 128, 30),
):
    register(_name, _fn, _window, _least)
_BUILT_IN.update(ENGINES)


def engine_outputs(y: np.ndarray, engines: dict[str, int], skip: frozenset[str] = frozenset(), failed: list[str] | None = None) -> dict[str, float]:
    """All outputs of the engines (name -> look-back) at the end of ``y``; an engine with
    too few observations, or that fails, gives NaN.  ``failed`` takes the names of those."""
    out: dict[str, float] = {}
    for name, window in engines.items():
        fn, _, least, names = ENGINES[name]
        own = clean(y[-window:])
        if name in skip or len(own) < least:
            out.update(dict.fromkeys(names, NAN))
            continue
        try:
            out.update(fn(own))
        except (np.linalg.LinAlgError, ValueError, FloatingPointError, ZeroDivisionError):
            out.update(dict.fromkeys(names, NAN))
            if failed is not None:
                failed.append(name)
    return out


# ---- distributions -------------------------------------------------------------------


def normal_cdf(x):
    from math import erf

    return 0.5 * (1 + erf(x / np.sqrt(2))) if np.isscalar(x) else np.array([0.5 * (1 + erf(v / np.sqrt(2))) for v in np.ravel(x)]).reshape(np.shape(x))


def normal_quantile(p) -> np.ndarray:
    p = np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12)
    return np.array([_STANDARD.inv_cdf(v) for v in p.ravel().tolist()]).reshape(p.shape)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(abs(v := 1 + num * d), 1e-300) * (1 if v >= 0 else -1)
        c = 1 + num / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return float(front * (f - 1))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - 0.5 * incomplete_beta(df / 2, 0.5, df / (df + mid * mid)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
