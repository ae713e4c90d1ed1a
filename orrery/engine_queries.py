"""Queries of single engines over the windows of ``events``, and the SQL that checks them.

Every engine's own look-back is used.  A window ends at row 63 of its signal and every 32
rows after.  In SQL, ``x`` holds a window's values ``v`` at the places ``t`` = 0, 1, ... of
the engine's look-back."""

from __future__ import annotations

import numpy as np

from .functions.kernels import ENGINES
from .operators.signal_vector import outputs_of, signal_vector
from .operators.typology import typology_windows
from .operators.windows import SIGNAL
from .queries import EVENTS, ORACLE_SQL, obs_events, query, r

WINDOW, STRIDE = 64, 32
K = "cohort, signal_id, window_id"
G = f"GROUP BY {K}"
P = f"PARTITION BY {K}"


def _x(n: int) -> str:
    """The windows' values, and those less their mean (``d``), of windows that are long enough."""
    return f"""{EVENTS}, nu AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0, value) - 1 AS i FROM ev),
kk AS (SELECT cohort, signal_id, (i - {WINDOW - 1}) // {STRIDE} AS window_id FROM nu WHERE i >= {WINDOW - 1} AND (i - {WINDOW - 1}) % {STRIDE} = 0),
x0 AS (SELECT e.cohort, e.signal_id, (e.i - {WINDOW - 1}) // {STRIDE} AS window_id, s.i - (e.i - {n - 1}) AS t, s.value AS v FROM nu e JOIN nu s ON s.cohort = e.cohort AND s.signal_id = e.signal_id AND s.i BETWEEN e.i - {n - 1} AND e.i
  WHERE e.i >= {WINDOW - 1} AND (e.i - {WINDOW - 1}) % {STRIDE} = 0 AND e.i >= {n - 1}),
x AS (SELECT *, v - avg(v) OVER w AS d, stddev_pop(v) OVER w AS sd FROM x0 WINDOW w AS ({P}))"""


def engine(name: str, sql: str, columns: list[str], integers: tuple[str, ...] = (), digits: int = 4) -> None:
    """Register ``engine_<name>``.  ``sql`` follows ``x`` and ends with a table ``o`` of the
    columns; windows that it lacks have nulls."""
    own = [c for c in columns if c in outputs_of([name])]
    n = ENGINES[name][1]
    listed = ", ".join(r(f"o.{c}", c, digits) for c in own)
    text = f"WITH {_x(n)}, {sql} SELECT kk.cohort, kk.signal_id, kk.window_id, {listed} FROM kk LEFT JOIN o USING ({K})"

    @query(f"engine_{name}", text, digits)
    def run(spark, sf_dir, own=tuple(own), name=name):
        return signal_vector(obs_events(spark, sf_dir), WINDOW, STRIDE, [name]).select(*SIGNAL, "window_id", *own)


def _moments(value: str, source: str, name: str = "mo") -> str:
    """m2, m3, m4 of a column of a table."""
    return f"""{name}c AS (SELECT *, {value} - avg({value}) OVER ({P}) AS c FROM {source}),
{name} AS (SELECT {K}, count(*) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM {name}c {G})"""


_KURT, _SKEW = "CASE WHEN m2 > 1e-15 THEN m4 / (m2 * m2) - 3 END", "CASE WHEN m2 > 1e-15 THEN m3 / power(m2, 1.5) END"

engine("statistics", f"{_moments('v', 'x')}, s AS (SELECT {K}, sqrt(avg(v * v)) AS q, max(abs(v)) AS p FROM x {G}), o AS (SELECT {K}, {_KURT} AS kurtosis, {_SKEW} AS skewness, CASE WHEN q > 1e-15 THEN p / q END AS crest_factor FROM mo JOIN s USING ({K}))", ["kurtosis", "skewness", "crest_factor"])
engine("size", f"o AS (SELECT {K}, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak, max(v) - min(v) AS peak_to_peak FROM x {G})", ["rms", "peak", "peak_to_peak"])
engine("pulsation_index", f"o AS (SELECT {K}, (max(v) - min(v)) / (abs(avg(v)) + 1e-10) AS pulsation_index, avg(v) AS flow_mean, max(v) - min(v) AS flow_range FROM x {G})", ["pulsation_index", "flow_mean", "flow_range"], digits=3)
engine("rate_of_change", f"y AS (SELECT *, v - lag(v) OVER ({P} ORDER BY t) AS e FROM x), o AS (SELECT {K}, avg(e) AS mean_rate, max(e) AS max_rate, min(e) AS min_rate, stddev_pop(e) AS rate_std, max(abs(e)) AS abs_max_rate FROM y {G})", ["mean_rate", "max_rate", "min_rate", "rate_std", "abs_max_rate"])
engine("trend", f"""y AS (SELECT *, sum(d) OVER ({P} ORDER BY t) AS c FROM x),
o AS (SELECT {K}, regr_slope(v, t) AS trend_slope, regr_r2(v, t) AS trend_r2, sqrt(greatest(var_pop(v) - power(regr_slope(v, t), 2) * var_pop(t), 0)) AS detrend_std, max(c) - min(c) AS cusum_range FROM y {G})""", ["trend_slope", "trend_r2", "detrend_std", "cusum_range"])
engine("mann_kendall", f"""p AS (SELECT a.cohort, a.signal_id, a.window_id, b.v - a.v AS e, b.t - a.t AS u FROM x a JOIN x b USING ({K}) WHERE b.t > a.t),
s AS (SELECT {K}, sum(sign(e)) AS s, median(e / u) AS m FROM p {G}), c AS (SELECT {K}, v, count(*) AS c FROM x GROUP BY {K}, v), q AS (SELECT {K}, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM c {G}),
w AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var FROM s JOIN q USING ({K})), o AS (SELECT {K}, CASE WHEN s = 0 OR var <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS mk_stat, m AS mk_slope FROM w)""", ["mk_stat", "mk_slope"])
engine("acf_decay", f"""p AS (SELECT a.cohort, a.signal_id, a.window_id, b.t - a.t AS lag, sum(a.d * b.d) AS s FROM x a JOIN x b USING ({K}) WHERE b.t BETWEEN a.t AND a.t + 24 GROUP BY 1, 2, 3, 4),
q AS (SELECT *, s / nullif(max(CASE WHEN lag = 0 THEN s END) OVER ({P}), 0) AS a FROM p),
o AS (SELECT {K}, max(CASE WHEN lag = 1 THEN a END) AS acf_lag1, max(CASE WHEN lag = 10 THEN a END) AS acf_lag10, min(CASE WHEN a < 0.5 THEN lag END) AS acf_half_life FROM q {G})""", ["acf_lag1", "acf_lag10", "acf_half_life"])
engine("variance_ratio", f"""y AS (SELECT *, {', '.join(f'v - lag(v, {q}) OVER w AS e{q}' for q in (1, 2, 4, 8))} FROM x WINDOW w AS ({P} ORDER BY t)),
z AS (SELECT {K}, max(sd) AS sd, var_samp(e1) AS b, {', '.join(f'var_samp(e{q}) / ({q} * var_samp(e1)) AS r{q}' for q in (2, 4, 8))} FROM y {G}),
o AS (SELECT {K}, r2 AS variance_ratio, r4 AS variance_ratio_4, r8 AS variance_ratio_8, (r2 - 1) / sqrt(2 / 64.0) AS variance_ratio_stat FROM z)""", ["variance_ratio", "variance_ratio_4", "variance_ratio_8", "variance_ratio_stat"])
engine("variance_growth", f"""y AS (SELECT *, sum(d) OVER ({P} ORDER BY t) AS c FROM x), z AS (SELECT {K}, k, var_pop(c) AS v FROM y JOIN (VALUES (4), (8), (16), (32)) AS s(k) ON t < k GROUP BY {K}, k),
o AS (SELECT {K}, regr_slope(ln(v), ln(k)) FILTER (v > 1e-15) AS variance_growth_rate, max(CASE WHEN k = 32 THEN v END) / max(CASE WHEN k = 16 THEN v END) / 2 AS variance_growth_ratio FROM z {G})""", ["variance_growth_rate", "variance_growth_ratio"])
engine("basin", f"""y AS (SELECT *, CAST(least(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 20), 19) AS INT) AS b FROM x WINDOW w AS ({P})), z AS (SELECT *, lag(b) OVER ({P} ORDER BY t) AS l FROM y),
c AS (SELECT {K}, b, count(*) AS c FROM y GROUP BY {K}, b), e AS (SELECT {K}, max(c) / 100.0 AS basin_stability, sum(CASE WHEN c > 2.5 THEN 1 ELSE 0 END) AS n_attractors FROM c {G}),
f AS (SELECT {K}, sum(CASE WHEN b <> l THEN 1 ELSE 0 END) / 99.0 AS transition_prob FROM z {G}), o AS (SELECT * FROM e JOIN f USING ({K}))""", ["basin_stability", "transition_prob", "n_attractors"])
engine("cycle_counting", f"""a AS (SELECT *, v - lag(v) OVER ({P} ORDER BY t) AS e FROM x), b AS (SELECT * FROM a WHERE e <> 0), c AS (SELECT *, CASE WHEN sign(e) = sign(lag(e) OVER ({P} ORDER BY t)) THEN 0 ELSE 1 END AS turn FROM b),
e AS (SELECT *, sum(turn) OVER ({P} ORDER BY t) AS leg FROM c), f AS (SELECT {K}, leg, abs(sum(e)) AS rg FROM e GROUP BY {K}, leg), g AS (SELECT *, max(rg) OVER ({P}) AS top FROM f),
o AS (SELECT {K}, count(*) // 2 AS n_cycles, avg(rg) AS mean_cycle_range, max(rg) AS max_cycle_range, sum(power(rg / top, 3) * 0.5) AS cycle_accumulation FROM g {G})""", ["n_cycles", "mean_cycle_range", "max_cycle_range", "cycle_accumulation"])
engine("time_constant", f"""a AS (SELECT *, v - lag(v) OVER ({P} ORDER BY t) AS e, ln(v - min(v) OVER ({P}) + 1e-10) AS l FROM x),
b AS (SELECT {K}, avg(CASE WHEN e > 0 THEN 1.0 WHEN e IS NOT NULL THEN 0.0 END) AS up, avg(CASE WHEN e < 0 THEN 1.0 WHEN e IS NOT NULL THEN 0.0 END) AS down, regr_slope(l, t) AS s, regr_r2(l, t) AS q, max(CASE WHEN t = 15 THEN v END) AS last FROM a {G}),
o AS (SELECT {K}, CASE WHEN abs(s) > 1e-15 THEN abs(1 / s) END AS tau, q AS tau_r2, last AS equilibrium_value, CAST(down >= 0.7 AS INT) AS is_decay FROM b WHERE up >= 0.7 OR down >= 0.7)""", ["tau", "tau_r2", "equilibrium_value", "is_decay"])
engine("lof", f"""s AS (SELECT {K}, v, row_number() OVER ({P} ORDER BY v) AS i FROM x),
p AS (SELECT a.cohort, a.signal_id, a.window_id, a.i, b.i AS j, abs(a.v - b.v) AS e FROM s a JOIN s b USING ({K}) WHERE a.i <> b.i AND abs(a.i - b.i) <= 20), q AS (SELECT *, row_number() OVER ({P}, i ORDER BY e, j) AS k FROM p),
n AS (SELECT * FROM q WHERE k <= 20), f AS (SELECT {K}, i, max(e) AS far FROM n GROUP BY {K}, i),
d AS (SELECT n.cohort, n.signal_id, n.window_id, n.i, 1 / greatest(avg(greatest(n.e, f.far)), 1e-10) AS density FROM n JOIN f ON f.cohort = n.cohort AND f.signal_id = n.signal_id AND f.window_id = n.window_id AND f.i = n.j GROUP BY 1, 2, 3, 4),
g AS (SELECT n.cohort, n.signal_id, n.window_id, n.i, avg(b.density) / any_value(a.density) AS score FROM n JOIN d a ON a.cohort = n.cohort AND a.signal_id = n.signal_id AND a.window_id = n.window_id AND a.i = n.i JOIN d b ON b.cohort = n.cohort AND b.signal_id = n.signal_id AND b.window_id = n.window_id AND b.i = n.j GROUP BY 1, 2, 3, 4),
o AS (SELECT {K}, max(score) AS lof_max, avg(score) AS lof_mean, avg(CASE WHEN score > 1.5 THEN 1.0 ELSE 0.0 END) AS outlier_fraction FROM g {G})""", ["lof_max", "lof_mean", "outlier_fraction"])

# ---- long memory and complexity ------------------------------------------------------

_SIZES = sorted({int(k) for k in np.geomspace(4, 16, 12).astype(int)})
engine("memory", f"""y AS (SELECT *, k, t // k AS part FROM x JOIN range(10, 16) AS s(k) ON t < (64 // k) * k), z AS (SELECT *, sum(e) OVER ({P}, k, part ORDER BY t) AS c FROM (SELECT *, v - avg(v) OVER ({P}, k, part) AS e FROM y)),
p AS (SELECT {K}, k, part, max(c) - min(c) AS rg, stddev_samp(v) AS s FROM z GROUP BY {K}, k, part), q AS (SELECT {K}, k, avg(rg / s) FILTER (s > 1e-15) AS rs FROM p GROUP BY {K}, k),
h AS (SELECT {K}, regr_slope(ln(rs), ln(k)) AS hurst, regr_r2(ln(rs), ln(k)) AS hurst_r2 FROM q {G}),
c AS (SELECT *, sum(d) OVER ({P} ORDER BY t) AS c FROM x), u AS (SELECT {K}, k, t // k AS part, t, c FROM c JOIN (VALUES {', '.join(f'({k})' for k in _SIZES)}) AS s(k) ON t < (64 // k) * k),
f AS (SELECT {K}, k, part, regr_syy(c, t) - power(regr_sxy(c, t), 2) / regr_sxx(c, t) AS ss, count(*) AS n FROM u GROUP BY {K}, k, part), g AS (SELECT {K}, k, sqrt(sum(ss) / sum(n)) AS f FROM f GROUP BY {K}, k),
l AS (SELECT {K}, regr_slope(ln(f), ln(k)) AS dfa FROM g {G}), o AS (SELECT * FROM h JOIN l USING ({K}))""", ["hurst", "hurst_r2", "dfa"])


def _templates(m: int) -> str:
    """Pairs of templates of length m, and whether they are within 0.2 deviations."""
    far = ", ".join(f"abs(a.v{k} - b.v{k})" for k in range(m))
    return f"SELECT a.cohort, a.signal_id, a.window_id, a.t AS i, b.t AS j, greatest({far}) <= 0.2 * a.sd AS near FROM l a JOIN l b USING ({K}) WHERE a.v{m - 1} IS NOT NULL AND b.v{m - 1} IS NOT NULL"


engine("complexity", f"""l AS (SELECT *, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM x WINDOW w AS ({P} ORDER BY t)), p2 AS ({_templates(2)}), p3 AS ({_templates(3)}),
s AS (SELECT {K}, sum(CASE WHEN near AND i <> j AND i < 62 AND j < 62 THEN 1 ELSE 0 END) AS b FROM p2 {G}), u AS (SELECT {K}, sum(CASE WHEN near AND i <> j THEN 1 ELSE 0 END) AS a FROM p3 {G}),
c2 AS (SELECT {K}, i, ln(sum(near::INT) / 63.0) AS c FROM p2 GROUP BY {K}, i), c3 AS (SELECT {K}, i, ln(sum(near::INT) / 62.0) AS c FROM p3 GROUP BY {K}, i), f2 AS (SELECT {K}, avg(c) AS f2 FROM c2 {G}), f3 AS (SELECT {K}, avg(c) AS f3 FROM c3 {G}),
k AS (SELECT {K}, CAST(v0 > v1 AS INT) + 2 * CAST(v0 > v2 AS INT) + 4 * CAST(v1 > v2 AS INT) AS k, count(*) / 62.0 AS q FROM l WHERE v2 IS NOT NULL GROUP BY ALL), e AS (SELECT {K}, -sum(q * log2(q)) / log2(6) AS permutation_entropy FROM k {G}),
o AS (SELECT {K}, CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END AS sample_entropy, permutation_entropy, f2 - f3 AS approximate_entropy FROM s JOIN u USING ({K}) JOIN f2 USING ({K}) JOIN f3 USING ({K}) JOIN e USING ({K}))""", ["sample_entropy", "permutation_entropy", "approximate_entropy"])

# ---- spectrum ------------------------------------------------------------------------


def _dft(n: int, source: str = "x", keys: str = K) -> str:
    """re, im of the transform of ``d``, for k = 0 to n - 1."""
    return f"SELECT {keys}, k, sum(d * cos(2 * pi() * k * t / {n})) AS re, -sum(d * sin(2 * pi() * k * t / {n})) AS im FROM {source}, range(0, {n}) AS s(k) GROUP BY {keys}, k"


_SPECTRUM = f"""f AS ({_dft(64)}), p AS (SELECT {K}, k, k / 64.0 AS f, (re * re + im * im) / 64 * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p FROM f WHERE k <= 32),
q AS (SELECT *, sum(p) OVER ({P}) AS total, max(CASE WHEN k > 0 THEN p END) OVER ({P}) AS top, row_number() OVER ({P} ORDER BY p DESC) AS place FROM p),
m AS (SELECT {K}, min(k) AS k0 FROM q WHERE k > 0 AND p = top {G}), c AS (SELECT {K}, sum(f * p) / sum(p) AS c FROM q {G}),
h AS (SELECT {K}, {', '.join(f'coalesce(max(CASE WHEN k = {j} * k0 THEN p END), 0) AS h{j}' for j in range(1, 6))} FROM q JOIN m USING ({K}) {G}),
s AS (SELECT {K}, any_value(k0) / 64.0 AS f0, any_value(c) AS c, any_value(total) AS total, sqrt(sum((f - c) * (f - c) * p) / any_value(total)) AS width, -sum(CASE WHEN p > 1e-20 THEN p / total * ln(p / total) ELSE 0 END) / ln(33) AS entropy,
  sum(CASE WHEN f <= 0.05 THEN p ELSE 0 END) AS low, sum(CASE WHEN f >= 0.05 AND f <= 0.25 THEN p ELSE 0 END) AS mid, sum(CASE WHEN f >= 0.25 THEN p ELSE 0 END) AS high, sum(CASE WHEN place <= 6 THEN p ELSE 0 END) AS sp, greatest(sum(CASE WHEN place > 6 THEN p ELSE 0 END), 1e-12) AS np FROM q JOIN m USING ({K}) JOIN c USING ({K}) {G}),
o AS (SELECT {K}, f0 AS dominant_freq, entropy AS spectral_entropy, c AS spectral_centroid, width AS spectral_bandwidth, low AS band_low, mid AS band_mid, high AS band_high, low / (total + 1e-10) AS band_low_rel, mid / (total + 1e-10) AS band_mid_rel, high / (total + 1e-10) AS band_high_rel, total AS total_power, 0.5 AS nyquist,
  f0 AS fundamental_freq, h1 AS fundamental_power, h1 / total AS fundamental_ratio, sqrt(h1) AS fundamental_amplitude, sqrt(h2) AS harmonic_2x, sqrt(h3) AS harmonic_3x, sqrt((h2 + h3 + h4 + h5) / h1) AS thd, 100 * sqrt((h2 + h3 + h4 + h5) / h1) AS thd_percent, CASE WHEN h2 + h3 + h4 + h5 > 0 THEN 20 * log10(sqrt((h2 + h3 + h4 + h5) / h1)) END AS thd_db,
  sp AS signal_power, np AS noise_power, sp / np AS snr_linear, 10 * log10(sp / np) AS snr_db FROM s JOIN h USING ({K}))"""
# the flatness of a spectrum whose mean was removed hangs on the rounding of its first bin: not compared
engine("spectral", _SPECTRUM, ["dominant_freq", "spectral_entropy", "spectral_centroid", "spectral_bandwidth", "band_low", "band_mid", "band_high", "band_low_rel", "band_mid_rel", "band_high_rel", "total_power", "nyquist", "fundamental_freq", "fundamental_power", "fundamental_ratio", "fundamental_amplitude", "harmonic_2x", "harmonic_3x", "thd", "thd_percent", "thd_db", "signal_power", "noise_power", "snr_linear", "snr_db"], digits=3)


def _analytic(n: int, source: str, keys: str) -> str:
    """ft and z: the analytic signal's re, im at every place."""
    return f"""ft AS ({_dft(n, source, keys)}), hh AS (SELECT {keys}, k, re * h AS re, im * h AS im FROM (SELECT *, CASE WHEN k = 0 OR k = {n // 2} THEN 1 WHEN k < {n // 2} THEN 2 ELSE 0 END AS h FROM ft)),
z AS (SELECT {keys}, t, sum(re * cos(2 * pi() * k * t / {n}) - im * sin(2 * pi() * k * t / {n})) / {n} AS re, sum(re * sin(2 * pi() * k * t / {n}) + im * cos(2 * pi() * k * t / {n})) / {n} AS im FROM hh, range(0, {n}) AS s(t) GROUP BY {keys}, t)"""


engine("hilbert", f"""{_analytic(32, 'x', K)}, a AS (SELECT {K}, t, sqrt(re * re + im * im) AS amp, atan2(im, re) AS ph FROM z), b AS (SELECT *, ph - lag(ph) OVER ({P} ORDER BY t) AS e FROM a),
fr AS (SELECT {K}, t - 1 AS t, (e - 2 * pi() * floor((e + pi()) / (2 * pi()))) / (2 * pi()) AS q, e FROM b WHERE e IS NOT NULL), {_moments('amp', 'a', 'ma')}, {_moments('q', 'fr', 'mf')},
u AS (SELECT {K}, sqrt(avg(amp * amp)) AS envelope_rms, max(amp) AS envelope_peak, stddev_pop(amp) / avg(amp) AS cv, regr_slope(amp, t) AS inst_amp_trend FROM a {G}),
w AS (SELECT {K}, avg(q) AS fm, stddev_pop(q) AS fs, max(q) - min(q) AS inst_freq_range, regr_slope(q, t) AS inst_freq_drift, sqrt(power(avg(cos(e)), 2) + power(avg(sin(e)), 2)) AS hilbert_phase_coherence FROM fr {G}),
o AS (SELECT u.*, cv AS inst_amp_cv, fm AS inst_freq_mean, fs AS inst_freq_std, 1 / (1 + fs / (abs(fm) + 1e-10)) AS inst_freq_stability, inst_freq_range, inst_freq_drift, hilbert_phase_coherence, cv / (fs / (abs(fm) + 1e-10)) AS am_fm_ratio, ma.m4 / (ma.m2 * ma.m2) - 3 AS envelope_kurtosis, mf.m4 / (mf.m2 * mf.m2) - 3 AS inst_freq_kurtosis, mf.m3 / power(mf.m2, 1.5) AS inst_freq_skewness
  FROM u JOIN w USING ({K}) JOIN ma USING ({K}) JOIN mf USING ({K}))""", ["envelope_rms", "envelope_peak", "envelope_kurtosis", "inst_freq_mean", "inst_freq_std", "inst_freq_stability", "inst_freq_kurtosis", "inst_freq_skewness", "inst_freq_range", "inst_freq_drift", "inst_amp_cv", "inst_amp_trend", "hilbert_phase_coherence", "am_fm_ratio"])
engine("phase_coherence", f"""y AS (SELECT {K}, t // 8 AS seg, t % 8 AS t, v - avg(v) OVER ({P}, t // 8) AS d FROM x), {_analytic(8, 'y', K + ', seg')}, a AS (SELECT {K}, seg, t, atan2(im, re) AS ph FROM z),
b AS (SELECT a.cohort, a.signal_id, a.window_id, a.seg, sqrt(power(avg(cos(b.ph - a.ph)), 2) + power(avg(sin(b.ph - a.ph)), 2)) AS c FROM a JOIN a b ON a.cohort = b.cohort AND a.signal_id = b.signal_id AND a.window_id = b.window_id AND a.t = b.t AND b.seg = a.seg + 1 GROUP BY 1, 2, 3, 4),
o AS (SELECT {K}, avg(c) AS phase_coherence, stddev_pop(c) AS phase_coherence_std, regr_slope(c, seg) AS phase_coherence_trend FROM b {G})""", ["phase_coherence", "phase_coherence_std", "phase_coherence_trend"])
engine("wavelet_stability", f"""f AS ({_dft(32)}), e AS (SELECT {K}, CASE WHEN k <= 6 THEN 0 WHEN k <= 11 THEN 1 ELSE 2 END AS b, sum(re * re + im * im) AS e FROM f WHERE k BETWEEN 1 AND 16 GROUP BY ALL), q AS (SELECT {K}, b, e / sum(e) OVER ({P}) AS q FROM e),
g AS (SELECT {K}, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) AS wavelet_entropy, max(q) AS wavelet_concentration, max_by(b, q) AS wavelet_dominant_scale FROM q {G}),
ro AS (SELECT {K}, t - 2 AS t, s FROM (SELECT *, (v * v + power(lag(v) OVER w, 2) + power(lag(v, 2) OVER w, 2)) / 3 AS s FROM x WINDOW w AS ({P} ORDER BY t)) WHERE s IS NOT NULL), {_moments('s', 'ro')},
l AS (SELECT {K}, regr_slope(s, t) AS wavelet_energy_drift, stddev_pop(s) AS wavelet_energy_std FROM ro {G}), o AS (SELECT *, {_KURT} AS wavelet_energy_kurtosis FROM g JOIN l USING ({K}) JOIN mo USING ({K}))""", ["wavelet_entropy", "wavelet_concentration", "wavelet_dominant_scale", "wavelet_energy_drift", "wavelet_energy_std", "wavelet_energy_kurtosis"], digits=3)

# ---- phase space ---------------------------------------------------------------------

_AMI = ", ".join(f"({k})" for k in range(1, 17))
_CELL = "CAST(least(floor(({0} - min({0}) OVER g) / (max({0}) OVER g - min({0}) OVER g) * 16), 15) AS INT)"
engine("phase_space", f"""l AS (SELECT *, {', '.join(f'lead(v, {k}) OVER w AS v{k}' for k in range(1, 5))} FROM x WINDOW w AS ({P} ORDER BY t)),
p AS (SELECT a.cohort, a.signal_id, a.window_id, a.t AS i, b.t AS j, sqrt(power(a.v - b.v, 2) + power(a.v1 - b.v1, 2) + power(a.v2 - b.v2, 2)) <= 0.1 * a.sd AS near FROM l a JOIN l b USING ({K}) WHERE a.v2 IS NOT NULL AND b.v2 IS NOT NULL),
rr AS (SELECT {K}, sum(near::INT) AS total FROM p {G}), rn AS (SELECT *, i - row_number() OVER ({P}, j - i ORDER BY i) AS isle FROM p WHERE near AND j > i), ru AS (SELECT {K}, j - i AS k, isle, count(*) AS n FROM rn GROUP BY ALL), di AS (SELECT {K}, sum(n) AS n FROM ru WHERE n >= 2 {G}),
e AS (SELECT a.cohort, a.signal_id, a.window_id, sqrt(power(a.v - b.v, 2) + {' + '.join(f'power(a.v{k} - b.v{k}, 2)' for k in range(1, 5))}) AS e FROM l a JOIN l b USING ({K}) WHERE a.v4 IS NOT NULL AND b.v4 IS NOT NULL AND a.t < b.t), e1 AS (SELECT * FROM e WHERE e > 1e-12),
qu AS (SELECT {K}, quantile_cont(e, 0.05) AS lo, quantile_cont(e, 0.5) AS hi, count(*) AS n FROM e1 {G}), ra AS (SELECT *, lo * power(hi / lo, s / 9.0) AS r FROM qu, range(0, 10) AS g(s)),
co AS (SELECT ra.cohort, ra.signal_id, ra.window_id, s, any_value(ra.r) AS r, sum((e < ra.r)::INT) / any_value(n) AS c FROM ra JOIN e1 USING ({K}) WHERE s < 9 GROUP BY 1, 2, 3, 4),
cd AS (SELECT {K}, regr_slope(ln(c), ln(r)) FILTER (c > 0) AS slope FROM co {G}),
la AS (SELECT a.cohort, a.signal_id, a.window_id, k, a.v AS u, b.v AS w FROM x a JOIN (VALUES {_AMI}) AS s(k) ON true JOIN x b ON a.cohort = b.cohort AND a.signal_id = b.signal_id AND a.window_id = b.window_id AND b.t = a.t + k),
ce AS (SELECT {K}, k, {_CELL.format('u')} AS a, {_CELL.format('w')} AS b FROM la WINDOW g AS ({P}, k)), c2 AS (SELECT {K}, k, a, b, count(*) * 1.0 AS c FROM ce GROUP BY ALL),
c3 AS (SELECT *, sum(c) OVER ({P}, k) AS n, sum(c) OVER ({P}, k, a) AS ca, sum(c) OVER ({P}, k, b) AS cb FROM c2), am AS (SELECT {K}, k, sum(c / n * ln(c * n / (ca * cb))) AS m FROM c3 GROUP BY ALL),
lo AS (SELECT *, lag(m) OVER g AS below, lead(m) OVER g AS above FROM am WINDOW g AS ({P} ORDER BY k)), de AS (SELECT {K}, min(k) AS k FROM lo WHERE m < below - 1e-12 AND m <= above + 1e-12 {G}),
o AS (SELECT {K}, total / power(62, 2) AS recurrence_rate, CASE WHEN total > 62 THEN coalesce(di.n, 0) / ((total - 62) / 2) ELSE 0 END AS determinism, de.k AS embedding_delay FROM rr LEFT JOIN di USING ({K}) LEFT JOIN de USING ({K}))""", ["recurrence_rate", "determinism", "embedding_delay"])

# ---- discrete states -----------------------------------------------------------------

_DISCRETE = f"""u AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM x WINDOW w AS ({P})), b AS (SELECT *, (SELECT sum((v > CASE WHEN g.e = 10 THEN hi ELSE lo + (hi - lo) * g.e / 10.0 END)::INT) FROM range(0, 11) AS g(e)) AS label FROM u),
s AS (SELECT {K}, t, v, dense_rank() OVER ({P} ORDER BY label) - 1 AS s FROM b), n AS (SELECT *, lead(s) OVER w AS nx, lag(s) OVER w AS pv, lag(v) OVER w AS lv FROM s WINDOW w AS ({P} ORDER BY t)),
c AS (SELECT {K}, s, count(*) / 32.0 AS p FROM s GROUP BY {K}, s), cc AS (SELECT *, row_number() OVER ({P} ORDER BY p DESC, s) AS place FROM c),
h AS (SELECT {K}, count(*) AS k, -sum(p * log2(p)) AS h, max(p) AS top, min(p) AS low, max(CASE WHEN place = 2 THEN p END) AS second, min(CASE WHEN place = 1 THEN s END) AS dominant, avg(p) AS mp FROM cc {G}),
tr AS (SELECT {K}, s, nx, count(*) * 1.0 AS c FROM n WHERE nx IS NOT NULL GROUP BY {K}, s, nx), tj AS (SELECT *, sum(c) OVER ({P}, s) AS row FROM tr),
je AS (SELECT {K}, -sum(c / 31 * log2(c / 31)) AS joint, -sum(c / 31 * log2(c / row)) AS cond, sum(CASE WHEN s = nx THEN c ELSE 0 END) / 31 AS loops, max(CASE WHEN s = nx THEN c / row ELSE 0 END) AS most, count(*) AS active FROM tj {G}),
tc AS (SELECT {K}, sum(CASE WHEN nx <> s THEN 1 ELSE 0 END) AS transition_count, stddev_pop(s) AS spread FROM n {G}),
ru AS (SELECT {K}, count(*) AS len FROM (SELECT *, sum(CASE WHEN v = lv THEN 0 ELSE 1 END) OVER ({P} ORDER BY t) AS run FROM n) GROUP BY {K}, run), dw AS (SELECT {K}, avg(len) AS dm, stddev_pop(len) AS ds, max(len) AS dx, min(len) AS dn, count(*) AS dc FROM ru {G}),
sr AS (SELECT {K}, s, run, count(*) AS len FROM (SELECT *, sum(CASE WHEN s = pv THEN 0 ELSE 1 END) OVER ({P} ORDER BY t) AS run FROM n) GROUP BY {K}, s, run), sa AS (SELECT {K}, s, avg(len) AS m FROM sr GROUP BY {K}, s), mt AS (SELECT {K}, avg(m) AS mm, stddev_pop(m) AS ms, max(m) AS mx, min(m) AS mn FROM sa {G}),
gi AS (SELECT a.cohort, a.signal_id, a.window_id, sum(abs(a.p - b.p)) AS g FROM c a JOIN c b USING ({K}) GROUP BY 1, 2, 3), un AS (SELECT {K}, 1 - sum(abs(p - 1.0 / k)) / 2 AS uniform FROM c JOIN h USING ({K}) {G}),
ta AS (SELECT {K}, sum(p) AS tail FROM (SELECT *, row_number() OVER ({P} ORDER BY p, s) AS place FROM c) JOIN h USING ({K}) WHERE place <= greatest(1, k // 5) {G}),
o AS (SELECT {K}, h AS shannon_entropy, CASE WHEN k > 1 THEN h / greatest(1, log2(least(k, 10))) ELSE 0 END AS normalized_entropy, greatest(0, cond) AS conditional_entropy, h - greatest(0, cond) AS excess_entropy, k AS n_levels, k / 32.0 AS level_occupancy, dominant AS dominant_level, spread AS level_spread, CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END AS level_entropy,
  uniform AS hist_uniformity, greatest(0, least(1, g / (2 * k * k * mp))) AS hist_concentration, top / mp AS hist_peak_ratio, tail AS hist_tail_weight, CASE WHEN k > 1 THEN cond ELSE 0 END AS trans_entropy, loops AS trans_self_loop, most AS trans_max_self_loop, active AS trans_n_active, 1 - active / (k * k * 1.0) AS trans_sparsity,
  transition_count, top AS duty_dominant, coalesce(second, 0) AS duty_secondary, top / second AS duty_ratio, h / log2(k) AS duty_balance, top - low AS duty_range, dm AS dwell_mean, ds AS dwell_std, dx AS dwell_max, dn AS dwell_min, ds / dm AS dwell_cv, dc AS n_dwells, mm AS mtb_mean, ms AS mtb_std, mx AS mtb_max, mn AS mtb_min, ms / mm AS mtb_cv
  FROM h JOIN je USING ({K}) JOIN tc USING ({K}) JOIN dw USING ({K}) JOIN mt USING ({K}) JOIN gi USING ({K}) JOIN un USING ({K}) JOIN ta USING ({K}))"""
engine("discrete", _DISCRETE, ["shannon_entropy", "normalized_entropy", "conditional_entropy", "excess_entropy", "n_levels", "level_occupancy", "dominant_level", "level_spread", "level_entropy", "hist_uniformity", "hist_concentration", "hist_peak_ratio", "hist_tail_weight", "trans_entropy", "trans_self_loop", "trans_max_self_loop", "trans_n_active", "trans_sparsity", "transition_count", "duty_dominant", "duty_secondary", "duty_ratio", "duty_balance", "duty_range", "dwell_mean", "dwell_std", "dwell_max", "dwell_min", "dwell_cv", "n_dwells", "mtb_mean", "mtb_std", "mtb_max", "mtb_min", "mtb_cv"])

# ---- what is made of engines ---------------------------------------------------------

_STRIDED = f"""{EVENTS}, nu AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0, value) - 1 AS i FROM ev), x0 AS (SELECT e.cohort, e.signal_id, (e.i - 29) // 5 AS window_id, s.i - (e.i - 29) AS t, s.value AS v, s.signal_0, e.signal_0 AS s1 FROM nu e JOIN nu s ON s.cohort = e.cohort AND s.signal_id = e.signal_id AND s.i BETWEEN e.i - 29 AND e.i WHERE e.i >= 29 AND (e.i - 29) % 5 = 0),
x AS (SELECT *, v - avg(v) OVER ({P}) AS d FROM x0), ends AS (SELECT {K}, min(signal_0) AS s0, max(s1) AS s1 FROM x0 {G})"""
_STABLE = {"h_freq_stability_mean": "avg(stab)", "h_freq_stability_min": "min(stab)", "h_freq_std_max": "max(fs)", "h_freq_drift_mean": "avg(drift)", "h_freq_drift_spread": "stddev_pop(drift)", "h_amp_cv_mean": "avg(cv)", "h_amp_trend_mean": "avg(atr)", "h_phase_coherence_mean": "avg(coh)", "h_phase_coherence_min": "min(coh)", "h_am_fm_ratio_mean": "avg(amfm)", "w_entropy_mean": "avg(we)", "w_concentration_mean": "avg(wc)", "w_energy_drift_mean": "avg(wd)", "w_energy_drift_max": "max(wd)", "w_temporal_std_mean": "avg(ws)", "w_intermittency_mean": "avg(wk)", "w_intermittency_max": "max(wk)", "w_energy_low_mean": "avg(el)", "w_energy_high_mean": "avg(eh)", "w_energy_ratio_mean": "avg(er)"}
ORACLE_SQL["signal_stability"] = f"""WITH {_STRIDED}, {_analytic(30, 'x', K)}, a AS (SELECT {K}, t, sqrt(re * re + im * im) AS amp, atan2(im, re) AS ph FROM z), b AS (SELECT *, ph - lag(ph) OVER ({P} ORDER BY t) AS e FROM a), fr AS (SELECT {K}, t - 1 AS t, (e - 2 * pi() * floor((e + pi()) / (2 * pi()))) / (2 * pi()) AS q, e FROM b WHERE e IS NOT NULL),
u AS (SELECT {K}, stddev_pop(amp) / avg(amp) AS cv, regr_slope(amp, t) AS atr FROM a {G}), w AS (SELECT {K}, avg(q) AS fm, stddev_pop(q) AS fs, regr_slope(q, t) AS drift, sqrt(power(avg(cos(e)), 2) + power(avg(sin(e)), 2)) AS coh FROM fr {G}),
en AS (SELECT {K}, (k - 1) // 5 AS b, sum(re * re + im * im) AS e FROM ft WHERE k BETWEEN 1 AND 15 GROUP BY ALL), sh AS (SELECT {K}, b, e / sum(e) OVER ({P}) AS q FROM en), we AS (SELECT {K}, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) AS we, max(q) AS wc, max(CASE WHEN b = 0 THEN q END) AS el, max(CASE WHEN b = 2 THEN q END) AS eh FROM sh {G}),
ro AS (SELECT {K}, t - 2 AS t, s FROM (SELECT *, (v * v + power(lag(v) OVER w, 2) + power(lag(v, 2) OVER w, 2)) / 3 AS s FROM x WINDOW w AS ({P} ORDER BY t)) WHERE s IS NOT NULL), {_moments('s', 'ro')}, wl AS (SELECT {K}, regr_slope(s, t) AS wd, stddev_pop(s) AS ws FROM ro {G}),
al AS (SELECT *, 1 / (1 + fs / (abs(fm) + 1e-10)) AS stab, cv / (fs / (abs(fm) + 1e-10)) AS amfm, el / eh AS er, {_KURT} AS wk FROM ends JOIN u USING ({K}) JOIN w USING ({K}) JOIN we USING ({K}) JOIN wl USING ({K}) JOIN mo USING ({K}))
SELECT cohort, window_id, {r('min(s0)', 'signal_0_start', 3)}, {r('max(s1)', 'signal_0_end', 3)}, {r('avg((s0 + s1) / 2)', 'signal_0_center', 3)}, count(*) AS n_signals, count(fs) AS n_hilbert_signals, count(we) AS n_wavelet_signals, {', '.join(r(v, k, 3) for k, v in _STABLE.items())} FROM al GROUP BY cohort, window_id"""

_TYPE = ["hurst", "perm_entropy", "sample_entropy", "kurtosis", "cv", "range_norm", "zero_crossing_rate", "trend_strength", "mean_abs_diff"]


@query("typology_measures", f"""WITH {_x(64)}, y AS (SELECT *, k, t // k AS part FROM x JOIN range(10, 16) AS s(k) ON t < (64 // k) * k), z AS (SELECT *, sum(e) OVER ({P}, k, part ORDER BY t) AS c FROM (SELECT *, v - avg(v) OVER ({P}, k, part) AS e FROM y)), p AS (SELECT {K}, k, part, max(c) - min(c) AS rg, stddev_samp(v) AS s FROM z GROUP BY {K}, k, part), q AS (SELECT {K}, k, avg(rg / s) FILTER (s > 1e-15) AS rs FROM p GROUP BY {K}, k), h AS (SELECT {K}, regr_slope(ln(rs), ln(k)) AS hurst FROM q {G}),
l AS (SELECT *, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2, lag(d) OVER w AS pd FROM x WINDOW w AS ({P} ORDER BY t)), p2 AS ({_templates(2)}), p3 AS ({_templates(3)}), sb AS (SELECT {K}, sum(CASE WHEN near AND i <> j AND i < 62 AND j < 62 THEN 1 ELSE 0 END) AS b FROM p2 {G}), sa AS (SELECT {K}, sum(CASE WHEN near AND i <> j THEN 1 ELSE 0 END) AS a FROM p3 {G}),
pk AS (SELECT {K}, CAST(v0 > v1 AS INT) + 2 * CAST(v0 > v2 AS INT) + 4 * CAST(v1 > v2 AS INT) AS k, count(*) / 62.0 AS q FROM l WHERE v2 IS NOT NULL GROUP BY ALL), pe AS (SELECT {K}, -sum(q * log2(q)) / log2(6) AS perm FROM pk {G}), {_moments('v', 'x')},
o AS (SELECT {K}, stddev_pop(v) / nullif(abs(avg(v)), 0) AS cv, (max(v) - min(v)) / nullif(abs(avg(v)), 0) AS rn, sum(CASE WHEN sign(d) <> sign(pd) THEN 1 ELSE 0 END) / 63.0 AS zc, least(greatest(regr_r2(v, t), 0), 1) AS tr, avg(abs(v1 - v0)) AS md FROM l {G})
SELECT cohort, signal_id, window_id, {r('hurst', 'hurst')}, {r('perm', 'perm_entropy')}, {r('CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END', 'sample_entropy')}, {r(_KURT, 'kurtosis')}, {r('cv', 'cv')}, {r('rn', 'range_norm')}, {r('zc', 'zero_crossing_rate')}, {r('tr', 'trend_strength')}, {r('md', 'mean_abs_diff')} FROM o JOIN h USING ({K}) JOIN sb USING ({K}) JOIN sa USING ({K}) JOIN pe USING ({K}) JOIN mo USING ({K})""")
def q_typology_measures(spark, sf_dir):
    """Of the typology's windows, without the exponent and the flatness."""
    return typology_windows(obs_events(spark, sf_dir), WINDOW, STRIDE).select(*SIGNAL, "window_id", *_TYPE)
