"""SQL for the queries that follow from the cohorts' geometry, and queries of those parts of
other results that SQL can express.

Groups have three features, so that eigenvalues of their covariance have a closed form
and eigenvectors are cross products of the rows of (A - lambda I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import features as FE
from .operators import fleet as L
from .operators import pairwise as P
from .operators import segments as SG
from .operators.geometry import SUMMARY
from .queries import _SEGMENTS, EVENTS, ITEMS, ORACLE_SQL, SENSORS, SHAPE, WIDE, _frames, _gradient_sql, obs_items, query, r, wide_items

GROUPS = {"shape": SHAPE, "trend": ["trend_slope", "trend_r2", "detrend_std"]}
WINDOWS = f"{EVENTS}, {_frames('ev')}"


def _values(n: str, a: dict[tuple[int, int], str]) -> str:
    """Columns e1, e2, e3: eigenvalues of a symmetric 3 x 3 matrix, in falling order, from a
    table ``n`` that has its entries."""
    q = f"({a[0, 0]} + {a[1, 1]} + {a[2, 2]}) / 3"
    off = f"({a[0, 1]} * {a[0, 1]} + {a[0, 2]} * {a[0, 2]} + {a[1, 2]} * {a[1, 2]})"
    x, y, z = (f"({a[i, i]} - q)" for i in range(3))
    det = f"({x} * ({y} * {z} - {a[1, 2]} * {a[1, 2]}) - {a[0, 1]} * ({a[0, 1]} * {z} - {a[1, 2]} * {a[0, 2]}) + {a[0, 2]} * ({a[0, 1]} * {a[1, 2]} - {y} * {a[0, 2]}))"
    first, last = "q + 2 * p * cos(ph)", "q + 2 * p * cos(ph + 2 * pi() / 3)"
    # n rows have n - 1 directions
    return f"""SELECT *, CASE WHEN n = 2 THEN 3 * q ELSE greatest({first}, 0) END AS e1, CASE WHEN n = 2 THEN 0 WHEN n = 3 THEN greatest(3 * q - ({first}), 0) ELSE greatest(3 * q - ({first}) - ({last}), 0) END AS e2, CASE WHEN n <= 3 THEN 0 ELSE greatest({last}, 0) END AS e3
  FROM (SELECT *, acos(greatest(-1, least(1, {det} / (2 * power(nullif(p, 0), 3))))) / 3 AS ph FROM (SELECT *, sqrt((power({x}, 2) + power({y}, 2) + power({z}, 2) + 2 * {off}) / 6) AS p FROM (SELECT *, {q} AS q FROM {n})))"""


def _eigen(e: str) -> str:
    f = GROUPS[e]
    a = {(i, j): f"a{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    full = " AND ".join(f"{c} IS NOT NULL" for c in f)
    entries = ", ".join(f"covar_samp({f[i]}, {f[j]}) / (stddev_pop({f[i]}) * stddev_pop({f[j]})) AS a{i}{j}" for i in range(3) for j in range(i, 3))
    parts = [
        f"ok_{e} AS (SELECT * FROM wf WHERE {full})",
        f"cv_{e} AS (SELECT cohort, window_id, count(*) AS n, min(signal_0_start) AS s0, max(signal_0_end) AS s1, avg(signal_0_center) AS sc, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(f))}, {entries} FROM ok_{e} GROUP BY cohort, window_id HAVING count(*) >= 2 AND {' AND '.join(f'stddev_pop({c}) >= 1e-12' for c in f)})",
        f"ev_{e} AS ({_values(f'cv_{e}', a)})",
    ]
    # cross products of two rows of A - lambda I; the longest of the three is the most exact
    rows = lambda k: [[f"({a[i, j]} - e{k})" if i == j else a[i, j] for j in range(3)] for i in range(3)]
    cross = []
    for k in (1, 2, 3):
        m = rows(k)
        for c, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))):
            cross += [f"{m[p][(i + 1) % 3]} * {m[q][(i + 2) % 3]} - {m[p][(i + 2) % 3]} * {m[q][(i + 1) % 3]} AS x{k}{c}{i}" for i in range(3)]
    size = lambda k, c: f"(x{k}{c}0 * x{k}{c}0 + x{k}{c}1 * x{k}{c}1 + x{k}{c}2 * x{k}{c}2)"
    best = lambda k, i: f"CASE WHEN {size(k, 0)} >= {size(k, 1)} AND {size(k, 0)} >= {size(k, 2)} THEN x{k}0{i} WHEN {size(k, 1)} >= {size(k, 2)} THEN x{k}1{i} ELSE x{k}2{i} END AS y{k}{i}"
    most = lambda k: f"greatest(abs(y{k}0), abs(y{k}1), abs(y{k}2)) * (1 - 1e-6)"
    sign = lambda k: f"sign(CASE WHEN abs(y{k}0) >= {most(k)} THEN y{k}0 WHEN abs(y{k}1) >= {most(k)} THEN y{k}1 ELSE y{k}2 END)"
    parts += [
        f"cr_{e} AS (SELECT *, {', '.join(cross)} FROM ev_{e})", f"be_{e} AS (SELECT *, {', '.join(best(k, i) for k in (1, 2, 3) for i in range(3))} FROM cr_{e})",
        f"vc_{e} AS (SELECT *, {', '.join(f'{sign(k)} * y{k}{i} / sqrt(y{k}0 * y{k}0 + y{k}1 * y{k}1 + y{k}2 * y{k}2) AS v{k}{i}' for k in (1, 2, 3) for i in range(3))} FROM be_{e})",
        f"tu_{e} AS (SELECT *, {', '.join(f'CASE WHEN least(e{k}, coalesce(lag(e{k}) OVER o, 0)) > 1e-9 AND ' + ' + '.join(f'v{k}{i} * lag(v{k}{i}) OVER o' for i in range(3)) + f' < 0 THEN 1 ELSE 0 END AS t{k}' for k in (1, 2, 3))} FROM vc_{e} WINDOW o AS (PARTITION BY cohort ORDER BY window_id))",
        f"st_{e} AS (SELECT *, {', '.join(f'1 - 2 * (sum(t{k}) OVER o % 2) AS g{k}' for k in (1, 2, 3))}, e1 + e2 + e3 AS total FROM tu_{e} WINDOW o AS (PARTITION BY cohort ORDER BY window_id))",
    ]
    h = " + ".join(f"CASE WHEN e{k} > 0 THEN -e{k} / total * log2(e{k} / total) ELSE 0 END" for k in (1, 2, 3))
    parts.append(f"""ge_{e} AS (SELECT cohort, window_id, '{e}' AS engine, s0 AS signal_0_start, s1 AS signal_0_end, sc AS signal_0_center, n AS n_signals, CAST(3 AS BIGINT) AS n_features, e1 AS eigenvalue_1, e2 AS eigenvalue_2, e3 AS eigenvalue_3, 0 AS eigenvalue_4, 0 AS eigenvalue_5,
  e1 / total AS explained_1, e2 / total AS explained_2, e3 / total AS explained_3, 0 AS explained_4, 0 AS explained_5, total * total / (e1 * e1 + e2 * e2 + e3 * e3) AS effective_dim, total AS total_variance, {h} AS eigenvalue_entropy, ({h}) / log2(3) AS eigenvalue_entropy_norm,
  e1 / CASE WHEN e3 > 1e-12 THEN e3 WHEN e2 > 1e-12 THEN e2 ELSE e1 END AS condition_number, e2 / e1 AS ratio_2_1, e3 / e1 AS ratio_3_1, t1 + t2 + t3 AS turns FROM st_{e})""")
    return ", ".join(parts)


def _jackknife(e: str) -> str:
    f = GROUPS[e]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    norm = " + ".join(f"{1 if i == j else 2} * power(b{i}{j}, 2)" for i, j in pairs)
    return f"""lo_{e} AS (SELECT a.cohort, a.window_id, a.signal_id, {', '.join(f'covar_samp(b.{f[i]}, b.{f[j]}) AS b{i}{j}' for i, j in pairs)} FROM ok_{e} a JOIN ok_{e} b ON a.cohort = b.cohort AND a.window_id = b.window_id AND a.signal_id <> b.signal_id GROUP BY 1, 2, 3 HAVING count(*) >= 3),
jk_{e} AS (SELECT cohort, window_id, count(*) AS k, avg(power(b00 + b11 + b22, 2) / ({norm})) AS centre, sqrt(count(*) - 1) * stddev_pop(power(b00 + b11 + b22, 2) / ({norm})) AS se FROM lo_{e} GROUP BY 1, 2)"""


GEOMETRY = f"{WINDOWS}, {_eigen('shape')}, {_eigen('trend')}, ge AS (SELECT * FROM ge_shape UNION ALL SELECT * FROM ge_trend)"

# fixed values: the 97.5 % points of Student's t for 3 to 5 degrees of freedom
_T = "CASE k WHEN 4 THEN 3.182446305284263 WHEN 5 THEN 2.7764451051977987 WHEN 6 THEN 2.5705818366147395 END"
_GE = ["signal_0_start", "signal_0_end", "signal_0_center", *SUMMARY]
ORACLE_SQL["cohort_geometry"] = f"""WITH {GEOMETRY}, {_jackknife('shape')}, {_jackknife('trend')}, jk AS (SELECT *, 'shape' AS engine FROM jk_shape UNION ALL SELECT *, 'trend' FROM jk_trend)
SELECT cohort, window_id, engine, n_signals, n_features, CAST(turns AS INTEGER) AS eigenvector_flip_count, {', '.join(r(c, c) for c in _GE)}, {r('se', 'eff_dim_std')}, {r(f'centre - {_T} * se', 'eff_dim_ci_low')}, {r(f'centre + {_T} * se', 'eff_dim_ci_high')} FROM ge LEFT JOIN jk USING (cohort, window_id, engine)"""

_ROW = "o.signal_0_start, o.signal_0_end, o.signal_0_center"


def _scores(e: str) -> str:
    f = GROUPS[e]
    score = lambda k: " + ".join(f"(o.{c} - m{i}) / d{i} * v{k}{i} * g{k}" for i, c in enumerate(f))
    return f"SELECT o.cohort, o.window_id, {_ROW}, '{e}' AS engine, o.signal_id, {', '.join(f'CASE WHEN e{k} > 1e-9 THEN {score(k)} ELSE 0 END AS pc{k}_loading' for k in (1, 2, 3))} FROM ok_{e} o JOIN st_{e} s ON o.cohort = s.cohort AND o.window_id = s.window_id"


POSITIONS = f"{GEOMETRY}, po AS ({_scores('shape')} UNION ALL {_scores('trend')})"
ORACLE_SQL["cohort_signal_positions"] = f"WITH {POSITIONS} SELECT cohort, window_id, engine, signal_id, {', '.join(r(c, c) for c in ('signal_0_start', 'signal_0_end', 'signal_0_center', 'pc1_loading', 'pc2_loading', 'pc3_loading'))} FROM po"
_LOAD = " UNION ALL ".join(f"SELECT cohort, window_id, '{e}' AS engine, '{c}' AS feature, v1{i} * g1 AS pc1_loading FROM st_{e}" for e, f in GROUPS.items() for i, c in enumerate(f))
ORACLE_SQL["cohort_feature_loadings"] = f"WITH {GEOMETRY}, lo AS ({_LOAD}) SELECT cohort, window_id, engine, feature, {r('pc1_loading', 'pc1_loading')} FROM lo"
ORACLE_SQL["signal_dominance"] = f"""WITH {POSITIONS}, bo AS (SELECT engine, signal_id, signal_0_end, cohort, pc1_loading, abs(pc1_loading) AS a FROM po UNION ALL SELECT 'aggregate', signal_id, signal_0_end, cohort, pc1_loading, abs(pc1_loading) FROM po),
ra AS (SELECT *, row_number() OVER (PARTITION BY engine, signal_id ORDER BY signal_0_end DESC, cohort DESC, a DESC) AS k FROM bo), ag AS (SELECT engine, signal_id, avg(a) AS m, max(CASE WHEN k = 1 THEN a END) AS last, sign(avg(pc1_loading)) AS s, count(*) AS n FROM ra GROUP BY 1, 2)
SELECT engine, signal_id, {r('m', 'mean_abs_loading')}, {r('last', 'final_abs_loading')}, {r('s', 'loading_sign')}, n AS n_windows, CAST(row_number() OVER (PARTITION BY engine ORDER BY m DESC, signal_id) AS INTEGER) AS dominance_rank FROM ag"""
_X, _C = [f"coalesce(w.{c}, c_{c}, 0)" for c in SHAPE], [f"coalesce(c_{c}, 0)" for c in SHAPE]
ORACLE_SQL["signal_geometry"] = f"""WITH {GEOMETRY}, ce AS (SELECT cohort, window_id, {', '.join(f'avg({c}) AS c_{c}' for c in SHAPE)} FROM wf WHERE coalesce({', '.join(SHAPE)}) IS NOT NULL GROUP BY 1, 2),
x AS (SELECT w.cohort, w.window_id, w.signal_0_end, w.signal_id, coalesce({', '.join(f'w.{c}' for c in SHAPE)}) IS NULL AS none, sqrt({' + '.join(f'power({a} - {b}, 2)' for a, b in zip(_X, _C, strict=True))}) AS dist, sqrt({' + '.join(f'power({a}, 2)' for a in _X)}) AS size, ({' + '.join(f'{a} * {b}' for a, b in zip(_X, _C, strict=True))}) / nullif(sqrt({' + '.join(f'power({b}, 2)' for b in _C)}), 0) AS along,
  {' + '.join(f'({a} - {b}) * v1{i} * g1' for i, (a, b) in enumerate(zip(_X, _C, strict=True)))} AS dot FROM wf w JOIN ce USING (cohort, window_id) LEFT JOIN st_shape s ON w.cohort = s.cohort AND w.window_id = s.window_id)
SELECT cohort, window_id, signal_id, 'shape' AS engine, {r('signal_0_end', 'signal_0_end')}, {', '.join(r(f'CASE WHEN NOT none THEN {v} END', k) for k, v in {'distance': 'dist', 'coherence': 'dot / nullif(dist, 0)', 'contribution': 'along', 'residual': 'sqrt(greatest(size * size - along * along, 0))', 'signal_magnitude': 'size'}.items())} FROM x"""

# ---- dynamics of the geometry --------------------------------------------------------

_SMOOTHED = ("effective_dim", "eigenvalue_1", "total_variance")


def _by_engine(sql: str) -> str:
    return sql.replace("PARTITION BY cohort ORDER BY s)", "PARTITION BY cohort, engine ORDER BY s)")


_O = "WINDOW o AS (PARTITION BY cohort, engine ORDER BY s)"
DYNAMICS = f"""{GEOMETRY}, g0 AS (SELECT cohort, engine, window_id, signal_0_end AS s, {', '.join(_SMOOTHED)}, count(*) OVER (PARTITION BY cohort, engine) AS n, row_number() OVER o - 1 AS t FROM (SELECT *, signal_0_end AS s FROM ge) {_O}),
g1 AS (SELECT *, {', '.join(f'CASE WHEN n > 3 THEN (coalesce(lag({c}) OVER o, 0) + {c} + coalesce(lead({c}) OVER o, 0)) / 3 ELSE {c} END AS z_{c}' for c in _SMOOTHED)} FROM g0 WHERE n >= 3 {_O}),
g2 AS (SELECT *, {', '.join(f"{_gradient_sql(f'z_{c}')} AS v_{c}" for c in _SMOOTHED)} FROM g1 {_O}), g3 AS (SELECT *, {_gradient_sql('v_effective_dim')} AS a, z_effective_dim - lag(z_effective_dim) OVER o < -0.05 AS falls FROM g2 {_O}),
g4 AS (SELECT *, {_gradient_sql('a')} AS j, sum(CASE WHEN falls THEN 0 ELSE 1 END) OVER o AS isle FROM g3 {_O}), rn AS (SELECT cohort, engine, isle, count(*) AS k, min(t) AS start FROM g4 WHERE falls GROUP BY 1, 2, 3 HAVING count(*) >= 3),
lg AS (SELECT cohort, engine, max_by(start, k * 100000 - start) AS onset FROM rn GROUP BY 1, 2), dy AS (SELECT cohort, engine, window_id, s AS signal_0_end, effective_dim, v_effective_dim AS effective_dim_velocity, a AS effective_dim_acceleration, j AS effective_dim_jerk, abs(a) / power(1 + power(v_effective_dim, 2), 1.5) AS effective_dim_curvature,
  eigenvalue_1, v_eigenvalue_1 AS eigenvalue_1_velocity, total_variance, v_total_variance AS variance_velocity, CAST(coalesce(onset, -1) AS BIGINT) AS collapse_onset_idx, onset * 1.0 / n AS collapse_onset_fraction FROM g4 LEFT JOIN lg USING (cohort, engine))"""
_DY = ["signal_0_end", "effective_dim", "effective_dim_velocity", "effective_dim_acceleration", "effective_dim_jerk", "effective_dim_curvature", "eigenvalue_1", "eigenvalue_1_velocity", "total_variance", "variance_velocity", "collapse_onset_fraction"]
ORACLE_SQL["geometry_dynamics"] = f"WITH {DYNAMICS} SELECT cohort, engine, collapse_onset_idx, {', '.join(r(c, c) for c in _DY)} FROM dy"
_H = " + ".join(f"CASE WHEN eigenvalue_{k} > 0 THEN -eigenvalue_{k} / total_variance * ln(eigenvalue_{k} / total_variance) ELSE 0 END" for k in (1, 2, 3))
ORACLE_SQL["thermodynamics"] = f"""WITH {GEOMETRY}, x AS (SELECT *, {_H} AS h, (effective_dim - lag(effective_dim) OVER o) / (signal_0_end - lag(signal_0_end) OVER o) AS rt FROM ge WINDOW o AS (PARTITION BY cohort, engine ORDER BY signal_0_end)),
y AS (SELECT cohort, engine, avg(h) AS h, avg(effective_dim) AS e, stddev_pop(effective_dim) AS es, var_pop(rt) AS t, count(*) AS n FROM x GROUP BY 1, 2)
SELECT cohort, engine, {r('h', 'entropy')}, {r('e', 'energy')}, {r('es', 'energy_std')}, {r('t', 'temperature')}, n AS n_samples, {r('e - coalesce(t, 0) * h', 'free_energy')} FROM y"""

# ---- the fleet -----------------------------------------------------------------------

_CELLS = {f"{e}_{m}": f"max(CASE WHEN engine = '{e}' THEN {m} END)" for e in GROUPS for m in L.METRICS}
FLEET = f"""{GEOMETRY}, p0 AS (SELECT cohort, window_id, signal_0_end, {', '.join(f'{v} AS {k}' for k, v in _CELLS.items())} FROM ge GROUP BY 1, 2, 3), pv AS (SELECT *, {', '.join(f'{e}_effective_dim - lag({e}_effective_dim) OVER (PARTITION BY cohort ORDER BY window_id) AS {e}_eff_dim_rate' for e in GROUPS)} FROM p0)"""
ORACLE_SQL["pivot_geometry"] = f"WITH {FLEET} SELECT cohort, window_id, {', '.join(r(c, c) for c in ('signal_0_end', *_CELLS, *(f'{e}_eff_dim_rate' for e in GROUPS)))} FROM pv"
_A, _B = "shape_effective_dim", "trend_effective_dim"
ORACLE_SQL["system_vector"] = f"""WITH {FLEET}, x AS (SELECT *, avg({_A}) OVER w AS ca, avg({_B}) OVER w AS cb FROM pv WINDOW w AS (PARTITION BY window_id)), y AS (SELECT *, sqrt(power({_A} - ca, 2) + power({_B} - cb, 2)) AS d FROM x)
SELECT window_id, {r('max(signal_0_end)', 'signal_0_end')}, count(*) AS n_cohorts, {r('avg(d)', 'mean_distance')}, {r('max(d)', 'max_distance')}, {r('stddev_pop(d)', 'std_distance')}, {r('any_value(ca)', f'centroid_{_A}')}, {r('any_value(cb)', f'centroid_{_B}')} FROM y GROUP BY window_id"""
# two standardised features: the eigenvalues are those of [[a, c], [c, a]]
SYSTEM = f"""{FLEET}, cp AS (SELECT * FROM pv WHERE {_A} IS NOT NULL AND {_B} IS NOT NULL), s0 AS (SELECT window_id, count(*) AS n, avg({_A}) AS ma, avg({_B}) AS mb, stddev_pop({_A}) AS da, stddev_pop({_B}) AS db, count(*) / (count(*) - 1.0) AS a, covar_samp({_A}, {_B}) / (stddev_pop({_A}) * stddev_pop({_B})) AS c FROM cp GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop({_A}) >= 1e-12 AND stddev_pop({_B}) >= 1e-12),
s1 AS (SELECT *, a + abs(c) AS e1, greatest(a - abs(c), 0) AS e2, 2 * a AS total FROM s0)"""
_H2 = " + ".join(f"CASE WHEN e{k} > 0 THEN -e{k} / (e1 + e2) * log2(e{k} / (e1 + e2)) ELSE 0 END" for k in (1, 2))
_SYS = {"eigenvalue_1": "e1", "eigenvalue_2": "e2", "eigenvalue_3": "0", "eigenvalue_4": "0", "eigenvalue_5": "0", "explained_1": "e1 / (e1 + e2)", "explained_2": "e2 / (e1 + e2)", "explained_3": "0", "explained_4": "0", "explained_5": "0", "effective_dim": "power(e1 + e2, 2) / (e1 * e1 + e2 * e2)", "total_variance": "e1 + e2", "eigenvalue_entropy": _H2, "eigenvalue_entropy_norm": _H2, "condition_number": "e1 / CASE WHEN e2 > 1e-12 THEN e2 ELSE e1 END", "ratio_2_1": "e2 / e1", "ratio_3_1": "0"}
ORACLE_SQL["system_geometry"] = f"WITH {SYSTEM} SELECT window_id, n AS n_cohorts, CAST(2 AS BIGINT) AS n_features, {', '.join(r(v, k) for k, v in _SYS.items())} FROM s1"
ORACLE_SQL["system_pairwise"] = f"""WITH {SYSTEM}, ps AS (SELECT cp.window_id, cp.cohort, {_A} AS x, {_B} AS y, (({_A} - ma) / da + sign(c) * ({_B} - mb) / db) / sqrt(2) AS l FROM cp LEFT JOIN s1 USING (window_id))
SELECT a.window_id, a.cohort AS cohort_a, b.cohort AS cohort_b, {r('sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))', 'distance')}, {r('(a.x * b.x + a.y * b.y) / (sqrt(a.x * a.x + a.y * a.y) * sqrt(b.x * b.x + b.y * b.y))', 'cosine_similarity')}, {r('sign(a.x - a.y) * sign(b.x - b.y)', 'correlation')}, {r('coalesce(abs(a.l * b.l), 0)', 'pc1_coloading')}, coalesce(abs(a.l * b.l), 0) > 0.3 AS needs_granger
FROM ps a JOIN ps b ON a.window_id = b.window_id AND a.cohort < b.cohort"""
ORACLE_SQL["system_velocity_field"] = f"""WITH {FLEET}, f0 AS (SELECT cohort, signal_0_end AS s, coalesce({_A}, avg({_A}) OVER w, 0) AS x, coalesce({_B}, avg({_B}) OVER w, 0) AS y, count(*) OVER w AS n FROM pv WINDOW w AS (PARTITION BY cohort)), f1 AS (SELECT *, s - lag(s) OVER o AS dt, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy FROM f0 WHERE n >= 3 WINDOW o AS (PARTITION BY cohort ORDER BY s)),
f2 AS (SELECT *, CASE WHEN abs(dx / dt) < 1e-12 THEN 0 ELSE dx / dt END AS vx, CASE WHEN abs(dy / dt) < 1e-12 THEN 0 ELSE dy / dt END AS vy FROM f1), f3 AS (SELECT *, (vx - lag(vx) OVER o) / ((dt + lag(dt) OVER o) / 2) AS ax, (vy - lag(vy) OVER o) / ((dt + lag(dt) OVER o) / 2) AS ay FROM f2 WINDOW o AS (PARTITION BY cohort ORDER BY s)),
f4 AS (SELECT *, vx * vx + vy * vy AS vv, coalesce(ax * ax + ay * ay, 0) AS aa, coalesce(vx * ax + vy * ay, 0) AS va FROM f3 WHERE dt IS NOT NULL)
SELECT cohort, {r('s', 'signal_0_end', 2)}, {r('sqrt(vv)', 'speed', 2)}, {r('CASE WHEN ax IS NOT NULL THEN sqrt(aa) END', 'acceleration_magnitude', 2)}, {r('CASE WHEN ax IS NOT NULL THEN va / nullif(sqrt(vv), 0) END', 'acceleration_parallel', 2)}, {r('CASE WHEN ax IS NOT NULL THEN sqrt(greatest(aa - coalesce(va * va / nullif(vv, 0), 0), 0)) END', 'acceleration_perpendicular', 2)},
{r('CASE WHEN ax IS NOT NULL THEN sqrt(greatest(aa - coalesce(va * va / nullif(vv, 0), 0), 0)) / (vv + 1e-12) END', 'curvature', 2)}, CASE WHEN abs(vy) >= abs(vx) THEN '{_B}' ELSE '{_A}' END AS dominant_motion_feature,
{r('CASE WHEN vv > 0 THEN exp(ln(vv) - (CASE WHEN vx <> 0 THEN vx * vx * ln(vx * vx) ELSE 0 END + CASE WHEN vy <> 0 THEN vy * vy * ln(vy * vy) ELSE 0 END) / vv) END', 'motion_dimensionality', 2)} FROM f4"""

# ---- trajectories and features -------------------------------------------------------

_MOTION = """vz AS (SELECT cohort, signal_id, signal_0, CASE WHEN stddev_pop(value) OVER g > 1e-10 THEN (value - avg(value) OVER g) / stddev_pop(value) OVER g ELSE 0 END AS x FROM ev WINDOW g AS (PARTITION BY cohort, signal_id)),
vv1 AS (SELECT *, x - lag(x) OVER o AS vel FROM vz WINDOW o AS (PARTITION BY cohort, signal_id ORDER BY signal_0)), vv2 AS (SELECT *, vel - lag(vel) OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS acc FROM vv1),
vs AS (SELECT cohort, signal_0, sum(vel * vel) AS vv, sum(coalesce(acc * acc, 0)) AS aa, sum(coalesce(vel * acc, 0)) AS va, count(acc) AS na FROM vv2 WHERE vel IS NOT NULL GROUP BY 1, 2),
vf AS (SELECT cohort, signal_0 AS signal_0_end, sqrt(vv) AS speed, CASE WHEN na > 0 THEN sqrt(aa) END AS acceleration_magnitude, CASE WHEN na > 0 THEN sqrt(greatest(aa - coalesce(va * va / nullif(vv, 0), 0), 0)) / (vv + 1e-12) END AS curvature FROM vs)"""


def _signed(e: str) -> str:
    """sg_<e>: the trajectory signatures of an engine."""
    step = " + ".join(f"coalesce(power({c} - lag({c}) OVER o, 2), 0)" for c in L.SIGNATURE)
    return f"""sa_{e} AS (SELECT g.cohort, g.signal_0_end, {', '.join(f'g.{c}' for c in L.SIGNATURE[:6])}, {', '.join(f'd.{c}' for c in L.SIGNATURE[6:9])}, speed, curvature, acceleration_magnitude FROM ge g JOIN dy d USING (cohort, engine, signal_0_end) JOIN vf v ON v.cohort = g.cohort AND v.signal_0_end = g.signal_0_end WHERE g.engine = '{e}'),
sb_{e} AS (SELECT *, sqrt({step}) AS step FROM sa_{e} WINDOW o AS (PARTITION BY cohort ORDER BY signal_0_end)), sg_{e} AS (SELECT *, sum(step) OVER (PARTITION BY cohort ORDER BY signal_0_end) AS arc_length FROM sb_{e})"""


SIGNATURES = f"{DYNAMICS}, {_MOTION}, {_signed('shape')}, {_signed('trend')}"
ORACLE_SQL["trajectory_signatures"] = f"WITH {SIGNATURES} SELECT cohort, {', '.join(r(c, c, 3) for c in ('signal_0_end', *L.SIGNATURE, 'arc_length'))}, CAST(NULL AS DOUBLE) AS torsion FROM sg_shape"


def _axis(e: str, axis: str) -> tuple[str, dict[str, str]]:
    """A table ax_<axis> of an axis's rows, and its features as aggregates."""
    table = f"""at_{axis} AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER p AS n, max(arc_length) OVER p AS total FROM sg_{e} WINDOW o AS (PARTITION BY cohort ORDER BY signal_0_end), p AS (PARTITION BY cohort)),
ax_{axis} AS (SELECT *, i < greatest(n // 3, 1) AS early, i >= n - greatest(n // 3, 1) AS late, coalesce(arc_length / nullif(total, 0), 0) AS place, power((i + 1.0) / n, 2) AS w FROM at_{axis})"""
    own = {f"{axis}_arc_length_total": "max(total)"}
    for m in FE.AXIS_METRICS:
        at = f"{axis}_{m}"
        e1, l1 = f"avg(CASE WHEN early THEN {m} END)", f"avg(CASE WHEN late THEN {m} END)"
        own |= {f"{at}_mean": f"avg({m})", f"{at}_std": f"stddev_pop({m})", f"{at}_min": f"min({m})", f"{at}_max": f"max({m})", f"{at}_range": f"max({m}) - min({m})", f"{at}_early": e1, f"{at}_late": l1, f"{at}_delta": f"{l1} - {e1}", f"{at}_slope": f"regr_slope({m}, i)"}
        own |= {f"{at}_q{q + 1}": f"avg(CASE WHEN place >= {q / 4} AND place < {(q + 1) / 4} THEN {m} END)" for q in range(3)}
        own[f"{at}_pos_weighted"] = f"sum(w * {m}) / sum(CASE WHEN {m} IS NOT NULL THEN w END)"
    own |= {f"{axis}_curvature_trend": "regr_slope(curvature, i)", f"{axis}_curvature_speed_product_late": "avg(CASE WHEN late THEN curvature * speed END)", f"{axis}_cond_spike_ratio": "CASE WHEN abs(avg(condition_number)) > 1e-10 THEN max(condition_number) / avg(condition_number) END"}
    return table, own


_T1, _F1 = _axis("shape", "shape")
ORACLE_SQL["trajectory_features"] = f"WITH {SIGNATURES}, {_T1} SELECT cohort, count(*) AS shape_n_windows, {', '.join(r(v, k, 3) for k, v in _F1.items())} FROM ax_shape GROUP BY cohort"
_T2, _F2 = _axis("trend", "trend")
_NEED = ["effective_dim_delta", "condition_number_late", "effective_dim_late"]
_DELTA, _COND, _DIM = (f"[shape_{c}, trend_{c}]" for c in _NEED)
_MEAN, _SPAN = (lambda x: f"list_avg({x})"), (lambda x: f"list_max({x}) - list_min({x})")
ORACLE_SQL["cross_axis_features"] = f"""WITH {SIGNATURES}, {_T1}, {_T2}, a1 AS (SELECT cohort, {', '.join(f"{_F1[f'shape_{c}']} AS shape_{c}" for c in _NEED)} FROM ax_shape GROUP BY 1), a2 AS (SELECT cohort, {', '.join(f"{_F2[f'trend_{c}']} AS trend_{c}" for c in _NEED)} FROM ax_trend GROUP BY 1),
f AS (SELECT *, coalesce((shape_effective_dim_delta < -0.15)::INT, 0) + coalesce((trend_effective_dim_delta < -0.15)::INT, 0) AS falls FROM a1 JOIN a2 USING (cohort))
SELECT cohort, CAST(falls AS INTEGER) AS cross_n_axes_collapsing, (falls > 0)::INT AS cross_collapse_on_any, (falls = 2)::INT AS cross_collapse_on_all, {r(f'list_min({_DELTA})', 'cross_min_dim_delta', 3)}, {r(f'list_max({_DELTA})', 'cross_max_dim_delta', 3)}, {r(_MEAN(_DELTA), 'cross_mean_dim_delta', 3)}, {r(_SPAN(_DELTA), 'cross_dim_delta_spread', 3)},
{r(_MEAN(_COND), 'cross_cond_late_mean', 3)}, {r(f'list_max({_COND})', 'cross_cond_late_max', 3)}, {r(f'list_stddev_pop({_COND})', 'cross_cond_late_std', 3)}, {r(_MEAN(_DIM), 'cross_dim_late_mean', 3)}, {r(f'list_min({_DIM})', 'cross_dim_late_min', 3)}, {r(f'list_stddev_pop({_DIM})', 'cross_dim_late_std', 3)} FROM f"""
_S = "shape_sub_"
_part = lambda c, when: f"avg(CASE WHEN {when} THEN {c} END)"
_SUB = {
    "eff_dim_min_mean": "avg(dmin)", "eff_dim_min_min": "min(dmin)", "cond_max_mean": "avg(cmax)", "cond_max_max": "max(cmax)", "eff_dim_spread_mean": "avg(ds)", "eff_dim_spread_max": "max(ds)", "cond_spread_mean": "avg(cs)", "cond_spread_max": "max(cs)", "frac_degenerate": "avg((cmax > 100)::INT)",
    "eff_dim_min_early": _part("dmin", "early"), "eff_dim_min_late": _part("dmin", "late"), "eff_dim_min_delta": f"{_part('dmin', 'late')} - {_part('dmin', 'early')}", "cond_max_early": _part("cmax", "early"), "cond_max_late": _part("cmax", "late"), "cond_max_delta": f"{_part('cmax', 'late')} - {_part('cmax', 'early')}", "eff_dim_min_slope": "regr_slope(dmin, i)", "eff_dim_spread_slope": "regr_slope(ds, i)",
}
ORACLE_SQL["sub_window_features"] = f"""WITH {GEOMETRY}, u0 AS (SELECT cohort, signal_0_end AS s, min(effective_dim) AS dmin, max(effective_dim) - min(effective_dim) AS ds, max(condition_number) AS cmax, max(condition_number) - min(condition_number) AS cs FROM ge GROUP BY 1, 2), u1 AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM u0),
u2 AS (SELECT *, i < greatest(n // 3, 1) AS early, i >= n - greatest(n // 3, 1) AS late FROM u1) SELECT cohort, CAST(sum((cmax > 100)::INT) AS BIGINT) AS {_S}n_degenerate, {', '.join(r(v, _S + k, 3) for k, v in _SUB.items())} FROM u2 GROUP BY cohort"""

# ---- windows -------------------------------------------------------------------------

ORACLE_SQL["kendall_trend"] = f"""WITH {WINDOWS}, p AS (SELECT a.cohort, a.signal_id, sign(b.std - a.std) AS s FROM wf a JOIN wf b ON a.cohort = b.cohort AND a.signal_id = b.signal_id AND a.window_id < b.window_id), k AS (SELECT cohort, signal_id, sum(s) AS s, sum(abs(s)) AS m, (1 + sqrt(1 + 8 * count(*))) / 2 AS n FROM p GROUP BY 1, 2),
z AS (SELECT *, abs(s) / sqrt(n * (n - 1) * (2 * n + 5) / 18) AS z FROM k) SELECT cohort, signal_id, {r('s / nullif(m, 0)', 'tau_std')}, {r('2 / (1 + exp(1.5976 * z + 0.070566 * power(z, 3)))', 'tau_std_pvalue')} FROM z"""
ORACLE_SQL["rolling_engine"] = f"""WITH {EVENTS}, nu AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0, value) - 1 AS i FROM ev), f AS (SELECT cohort, signal_id, signal_0, value, i, avg(value) OVER w AS m, sqrt(avg(value * value) OVER w) AS q, max(abs(value)) OVER w AS top, list(value) OVER w AS l FROM nu WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, {', '.join(f'list_avg(list_transform(l, lambda v: power(v - m, {k}))) AS m{k}' for k in (2, 3, 4))} FROM f)
SELECT cohort, signal_id, {r('signal_0', 'signal_0')}, {r('value', 'value')}, {', '.join(r(f'CASE WHEN i >= 15 THEN {v} END', f'rolling_{k}') for k, v in {'kurtosis': 'CASE WHEN m2 > 1e-15 THEN m4 / (m2 * m2) - 3 END', 'skewness': 'CASE WHEN m2 > 1e-15 THEN m3 / power(m2, 1.5) END', 'crest_factor': 'CASE WHEN q > 1e-15 THEN top / q END'}.items())} FROM g"""

# ---- the parts of four-sensor results that need no eigen solver -----------------------

_PAIRS4 = [(a, b) for a in SENSORS for b in SENSORS]
_EFF = lambda sd: f"power({' + '.join(f'covar_samp({a}, {a}) / power(stddev_pop({a}), 2)' for a in SENSORS)}, 2) / ({' + '.join(f'power(covar_samp({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 2)' for a, b in _PAIRS4)})"
_TOT = " + ".join(f"covar_samp({a}, {a}) / power(stddev_pop({a}), 2)" for a in SENSORS)


@query("segment_dimension", f"""WITH {WIDE}, s AS (SELECT cohort, CASE WHEN signal_0 <= 99 THEN 0 ELSE 1 END AS o, count(*) AS n, {_EFF(0)} AS e FROM wide WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SENSORS)} GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT a.cohort, 'early' AS segment_a, 'late' AS segment_b, a.n AS n_samples_a, b.n AS n_samples_b, {r('a.e', 'eff_dim_a')}, {r('b.e', 'eff_dim_b')}, {r('b.e - a.e', 'eff_dim_delta')} FROM s a JOIN s b ON a.cohort = b.cohort AND a.o = 0 AND b.o = 1""")
def q_segment_dimension(spark, sf_dir):
    made = SG.segment_comparison(wide_items(spark, sf_dir), SENSORS, _SEGMENTS)
    return made.select("cohort", "segment_a", "segment_b", "n_samples_a", "n_samples_b", "eff_dim_a", "eff_dim_b", "eff_dim_delta")


_BASE = f"""{WIDE}, w1 AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY signal_0) AS i, count(*) OVER (PARTITION BY cohort) AS n FROM wide), w2 AS (SELECT * FROM w1 WHERE i <= greatest(ceil(n * 0.2), 3)),
ba AS (SELECT cohort, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SENSORS)}, {_EFF(0)} AS e, {_TOT} AS total FROM w2 GROUP BY 1)"""


@query("baseline_dimension", f"WITH {_BASE} SELECT cohort, n AS n_baseline_cycles, {r('e', 'baseline_effective_dim')}, {r('total', 'baseline_total_variance')}, {', '.join(r(f'm_{c}', f'centroid_{c}') + ', ' + r(f's_{c}', f'std_{c}') for c in SENSORS)} FROM ba")
def q_baseline_dimension(spark, sf_dir):
    made = SG.cohort_baseline(wide_items(spark, sf_dir), SENSORS)
    return made.select("cohort", "n_baseline_cycles", "baseline_effective_dim", "baseline_total_variance", *[F.col(x)[i].alias(f"{x}_{c}") for i, c in enumerate(SENSORS) for x in ("centroid", "std")])


@query("observation_distances", f"""WITH {_BASE} SELECT cohort, {r('signal_0', 'signal_0')}, {r('sqrt(' + ' + '.join(f'power({c} - m_{c}, 2)' for c in SENSORS) + ')', 'centroid_distance')}, {r('sqrt(' + ' + '.join(f'CASE WHEN s_{c} > 1e-12 THEN power(({c} - m_{c}) / s_{c}, 2) ELSE 0 END' for c in SENSORS) + ')', 'centroid_distance_norm')}, {r('sqrt(' + ' + '.join(f'{c} * {c}' for c in SENSORS) + ')', 'sensor_norm')} FROM wide JOIN ba USING (cohort)""")
def q_observation_distances(spark, sf_dir):
    wide = wide_items(spark, sf_dir)
    return SG.observation_geometry(wide, SG.cohort_baseline(wide, SENSORS), SENSORS).select("cohort", "signal_0", "centroid_distance", "centroid_distance_norm", "sensor_norm")


_MEANS = ", ".join(f"avg({c}) OVER f AS {c}" for c in SENSORS)


@query("sensor_dimension", f"""WITH {WIDE}, w1 AS (SELECT cohort, signal_0, row_number() OVER (PARTITION BY cohort ORDER BY signal_0) - 1 AS i, {_MEANS} FROM wide WINDOW f AS (PARTITION BY cohort ORDER BY signal_0 ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), w2 AS (SELECT cohort, signal_0, row_number() OVER (PARTITION BY cohort ORDER BY signal_0) AS k, {', '.join(SENSORS)} FROM w1 WHERE i >= 29 AND (i - 29) % 5 = 0),
w3 AS (SELECT a.cohort, a.signal_0, count(*) AS n, {', '.join(f'covar_samp(b.{a}, b.{b}) / (stddev_pop(b.{a}) * stddev_pop(b.{b})) AS c_{a}_{b}' for a, b in _PAIRS4)}, {' AND '.join(f'stddev_pop(b.{c}) >= 1e-12' for c in SENSORS)} AS ok FROM w2 a JOIN w2 b ON a.cohort = b.cohort AND b.k BETWEEN a.k - 29 AND a.k GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT cohort, {r('signal_0', 'signal_0_end')}, n AS n_samples, {r(' + '.join(f'c_{a}_{a}' for a in SENSORS), 'total_variance', 3)}, {r('power(' + ' + '.join(f'c_{a}_{a}' for a in SENSORS) + ', 2) / (' + ' + '.join(f'power(c_{a}_{b}, 2)' for a, b in _PAIRS4) + ')', 'effective_dim', 3)} FROM w3 WHERE ok""", 3)
def q_sensor_dimension(spark, sf_dir):
    return SG.sensor_eigendecomp(wide_items(spark, sf_dir), SENSORS).select("cohort", "signal_0_end", "n_samples", "total_variance", "effective_dim")


# ---- warnings ------------------------------------------------------------------------

ORACLE_SQL["critical_slowing_down"] = f"""WITH {EVENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0, value) - 1 AS i FROM ev), l AS (SELECT cohort, signal_id, regr_slope(value, i) AS b, avg(value) AS m, avg(i) AS c FROM a GROUP BY 1, 2),
f AS (SELECT cohort, signal_id, i, value - m - coalesce(b, 0) * (i - c) AS v FROM a JOIN l USING (cohort, signal_id)), w AS (SELECT e.cohort, e.signal_id, (e.i - 49) // 10 AS window_id, s.i - e.i + 49 AS t, s.v FROM f e JOIN f s ON e.cohort = s.cohort AND e.signal_id = s.signal_id AND s.i BETWEEN e.i - 49 AND e.i WHERE e.i >= 49 AND (e.i - 49) % 10 = 0),
d AS (SELECT *, v - avg(v) OVER g AS d FROM w WINDOW g AS (PARTITION BY cohort, signal_id, window_id)), n AS (SELECT *, lead(d) OVER (PARTITION BY cohort, signal_id, window_id ORDER BY t) AS x FROM d),
m AS (SELECT cohort, signal_id, window_id, sum(d * x) / sum(d * d) AS ac, var_samp(v) AS va, avg(power(d, 3)) / power(var_samp(v), 1.5) AS sk FROM n GROUP BY 1, 2, 3),
o AS (SELECT cohort, signal_id, count(*) AS n, max_by(ac, window_id) AS ac, max_by(va, window_id) AS va, max_by(sk, window_id) AS sk, regr_slope(ac, window_id) AS act, regr_r2(ac, window_id) AS acr, regr_slope(va, window_id) AS vat, regr_r2(va, window_id) AS var, min_by(va, window_id) AS va0 FROM m GROUP BY 1, 2),
q AS (SELECT *, 0.3 * least(greatest(coalesce(ac, 0), 0), 1) + 0.25 * least(greatest(coalesce(CASE WHEN act > 0 THEN acr END, 0), 0), 1) + 0.25 * least(greatest(coalesce(CASE WHEN vat > 0 THEN var END, 0), 0), 1) + 0.2 * least(greatest(coalesce(abs(sk), 0), 0), 1) AS score FROM o)
SELECT cohort, signal_id, n AS n_windows, {r('ac', 'autocorrelation_lag1')}, {r('va', 'variance')}, {r('sk', 'skewness')}, {r('act', 'autocorr_trend')}, {r('acr', 'autocorr_trend_r2')}, {r('vat', 'variance_trend')}, {r('var', 'variance_trend_r2')}, {r('CASE WHEN ac > 0 THEN -ln(ac) END', 'recovery_rate')}, {r('va / nullif(va0, 0)', 'variance_ratio')}, {r('score', 'csd_score')}, coalesce(score > 0.6 AND ac > 0.7 AND vat > 0, false) AS csd_detected FROM q"""


_MEANS3 = ", ".join(f"avg({c}) AS f{i}" for i, c in enumerate(SHAPE))
ORACLE_SQL["recurrence_measures"] = f"""WITH {EVENTS}, {_frames('ev', 32, 8)}, st AS (SELECT cohort, window_id, max(signal_0_end) AS s, {_MEANS3} FROM wf WHERE coalesce({', '.join(SHAPE)}) IS NOT NULL GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY s) AS i FROM st WHERE {' AND '.join(f'f{k} IS NOT NULL' for k in range(3))}),
d AS (SELECT a.cohort, a.i, b.i AS j, sqrt({' + '.join(f'power(a.f{k} - b.f{k}, 2)' for k in range(3))}) AS d FROM x a JOIN x b USING (cohort)), q AS (SELECT cohort, quantile_cont(d, 0.1) AS q, count(*) AS nn FROM d GROUP BY 1), r AS (SELECT d.*, nn, d <= q + 1e-9 AS near FROM d JOIN q USING (cohort)),
dg AS (SELECT cohort, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY cohort, j - i ORDER BY i) AS isle FROM r WHERE near AND j > i) GROUP BY cohort, j - i, isle HAVING count(*) >= 2), vg AS (SELECT cohort, count(*) AS n FROM (SELECT *, j - row_number() OVER (PARTITION BY cohort, i ORDER BY j) AS isle FROM r WHERE near) GROUP BY cohort, i, isle HAVING count(*) >= 2),
t AS (SELECT cohort, sum(near::INT) AS total, sqrt(max(nn)) AS n FROM r GROUP BY 1), ds AS (SELECT cohort, sum(n) AS s, max(n) AS m FROM dg GROUP BY 1), vs AS (SELECT cohort, sum(n) AS s, avg(n) AS a FROM vg GROUP BY 1), dc AS (SELECT cohort, n, count(*) AS c FROM dg GROUP BY 1, 2), de AS (SELECT cohort, -sum(p * ln(p)) AS h FROM (SELECT cohort, c / sum(c) OVER (PARTITION BY cohort) AS p FROM dc) GROUP BY 1)
SELECT cohort, CAST(n AS BIGINT) AS n_points, {r('total / (n * n)', 'recurrence_rate')}, {r('CASE WHEN total > n THEN coalesce(ds.s, 0) / ((total - n) / 2) ELSE 0 END', 'determinism')}, {r('coalesce(vs.s, 0) / total', 'laminarity')}, {r('coalesce(vs.a, 0)', 'trapping_time')}, {r('coalesce(h, 0)', 'rqa_entropy')}, {r('coalesce(ds.m, 0)', 'longest_diagonal')} FROM t LEFT JOIN ds USING (cohort) LEFT JOIN vs USING (cohort) LEFT JOIN de USING (cohort)"""

# ---- dependence of pairs -------------------------------------------------------------

_PK = "cohort, signal_a, signal_b"
_FLOWN = f"""{ITEMS}, pr AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, a.signal_0, a.value AS x, b.value AS y FROM li a JOIN li b ON a.cohort = b.cohort AND a.signal_0 = b.signal_0 AND a.signal_id < b.signal_id),
la AS (SELECT *, row_number() OVER (PARTITION BY {_PK} ORDER BY signal_0 DESC) AS k FROM pr), p AS (SELECT *, row_number() OVER (PARTITION BY {_PK} ORDER BY signal_0) - 1 AS t, count(*) OVER (PARTITION BY {_PK}) AS n FROM la WHERE k <= 2000)"""


def _cell(v: str, low: str, high: str, bins: int) -> str:
    """The equal-width bin of a value; one on an edge belongs to the bin above."""
    at, step = f"least(floor(({v} - {low}) / ({high} - {low}) * {bins}), {bins - 1})", f"(({high} - {low}) / {bins})"
    return f"CAST({at} - ({v} < {at} * {step} + {low})::INT + ({at} < {bins - 1} AND {v} >= ({at} + 1) * {step} + {low})::INT AS INT)"


def _entropy(columns: str, name: str, source: str = "tl") -> str:
    return f"{name} AS (SELECT {_PK}, -sum(c / s * ln(c / s)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY {_PK}) AS s FROM (SELECT {_PK}, {columns}, count(*) * 1.0 AS c FROM {source} GROUP BY ALL)) GROUP BY ALL)"


_CUT = lambda v: f"CAST(least(trunc(({v} - min({v}) OVER g) / (max({v}) OVER g - min({v}) OVER g) * 8), 7) AS INT)"
_TE = f"""cu AS (SELECT {_PK}, t, {_CUT('x')} AS a, {_CUT('y')} AS b FROM p WINDOW g AS (PARTITION BY {_PK})), tl AS (SELECT * FROM (SELECT *, lead(a) OVER o AS a1, lead(b) OVER o AS b1 FROM cu WINDOW o AS (PARTITION BY {_PK} ORDER BY t)) WHERE a1 IS NOT NULL),
{_entropy('b1, b', 'h1')}, {_entropy('b, a', 'h2')}, {_entropy('b', 'h3')}, {_entropy('b1, b, a', 'h4')}, {_entropy('b', 'hb', 'cu')}, {_entropy('a1, a', 'h5')}, {_entropy('a', 'h6')}, {_entropy('a1, a, b', 'h7')}, {_entropy('a', 'ha', 'cu')}"""
_DEP = ["transfer_entropy_a_to_b", "transfer_entropy_b_to_a", "mutual_info", "normalized_mi", "kl_divergence_a_to_b", "kl_divergence_b_to_a", "js_divergence", "hedge_ratio", "half_life", "spread_zscore", "kendall_tau", "spearman_rho", "lower_tail_dependence", "upper_tail_dependence", "tail_asymmetry"]
_KLS = lambda a, b: f"sum(CASE WHEN {a} > 0 THEN {a} * ln(({a} + 1e-10) / ({b} + 1e-10)) ELSE 0 END)"


@query("information_flow_measures", f"""WITH {_FLOWN}, {_TE}, te AS (SELECT {_PK}, greatest(h1.h + h2.h - h3.h - h4.h, 0) / hb.h AS ab, greatest(h5.h + h2.h - h6.h - h7.h, 0) / ha.h AS ba FROM h1 JOIN h2 USING ({_PK}) JOIN h3 USING ({_PK}) JOIN h4 USING ({_PK}) JOIN hb USING ({_PK}) JOIN h5 USING ({_PK}) JOIN h6 USING ({_PK}) JOIN h7 USING ({_PK}) JOIN ha USING ({_PK})),
en AS (SELECT {_PK}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, least(min(x), min(y)) AS l, greatest(max(x), max(y)) AS u, regr_slope(x, y) AS beta, regr_intercept(x, y) AS alpha, max(n) AS n FROM p GROUP BY ALL),
bi AS (SELECT {_PK}, {_cell('x', 'x0', 'x1', 10)} AS i, {_cell('y', 'y0', 'y1', 10)} AS j FROM p JOIN en USING ({_PK})), c2 AS (SELECT {_PK}, i, j, count(*) * 1.0 AS c FROM bi GROUP BY ALL), c3 AS (SELECT *, sum(c) OVER w AS n, sum(c) OVER (PARTITION BY {_PK}, i) AS ci, sum(c) OVER (PARTITION BY {_PK}, j) AS cj FROM c2 WINDOW w AS (PARTITION BY {_PK})), mi AS (SELECT {_PK}, greatest(sum(c / n * ln(c * n / (ci * cj))), 0) AS mi, -sum(c / n * ln(ci / n)) AS hx, -sum(c / n * ln(cj / n)) AS hy FROM c3 GROUP BY ALL),
kb AS (SELECT {_PK}, {_cell('x', 'l', 'u', 20)} AS b, 1 AS f, 0 AS g FROM p JOIN en USING ({_PK}) UNION ALL SELECT {_PK}, {_cell('y', 'l', 'u', 20)}, 0, 1 FROM p JOIN en USING ({_PK})), kc AS (SELECT {_PK}, b, sum(f) AS f, sum(g) AS g FROM kb GROUP BY {_PK}, b), kd AS (SELECT {_PK}, b, f / sum(f) OVER w AS p, g / sum(g) OVER w AS q, (f / sum(f) OVER w + g / sum(g) OVER w) / 2 AS m FROM kc WINDOW w AS (PARTITION BY {_PK})),
kl AS (SELECT {_PK}, {_KLS('p', 'q')} AS pq, {_KLS('q', 'p')} AS qp, 0.5 * {_KLS('p', 'm')} + 0.5 * {_KLS('q', 'm')} AS js FROM kd GROUP BY ALL),
re AS (SELECT {_PK}, t, x - alpha - beta * y AS e FROM p JOIN en USING ({_PK})), rl AS (SELECT *, lag(e) OVER (PARTITION BY {_PK} ORDER BY t) AS b FROM re), ct AS (SELECT {_PK}, regr_slope(e, b) FILTER (b IS NOT NULL) AS phi, max_by(e, t) / stddev_pop(e) AS z FROM rl GROUP BY ALL),
sm AS (SELECT DISTINCT {_PK}, CASE WHEN n > 1000 THEN CAST(floor(k * ((n - 1) / 999.0::DOUBLE)) AS BIGINT) ELSE k END AS t FROM en, range(0, 1000) AS s(k) WHERE k < n), sp AS (SELECT p.* FROM p JOIN sm USING ({_PK}, t)), uv AS (SELECT {_PK}, x, y, row_number() OVER (PARTITION BY {_PK} ORDER BY x, t) / (count(*) OVER (PARTITION BY {_PK}) + 1.0) AS u, row_number() OVER (PARTITION BY {_PK} ORDER BY y, t) / (count(*) OVER (PARTITION BY {_PK}) + 1.0) AS v FROM sp),
ta AS (SELECT {_PK}, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sum(abs(sign(a.x - b.x) * sign(a.y - b.y))) AS tau FROM uv a JOIN uv b USING ({_PK}) GROUP BY ALL), tl2 AS (SELECT {_PK}, corr(u, v) AS rho, sum((u <= 0.1 AND v <= 0.1)::INT) / sum((u <= 0.1)::INT) AS lo, sum((u > 0.9 AND v > 0.9)::INT) / sum((u > 0.9)::INT) AS hi FROM uv GROUP BY ALL)
SELECT {_PK}, en.n AS n_samples, {r('ab', 'transfer_entropy_a_to_b')}, {r('ba', 'transfer_entropy_b_to_a')}, {r('mi', 'mutual_info')}, {r('mi / sqrt(hx * hy)', 'normalized_mi')}, {r('pq', 'kl_divergence_a_to_b')}, {r('qp', 'kl_divergence_b_to_a')}, {r('js', 'js_divergence')}, {r('beta', 'hedge_ratio')}, {r('CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END', 'half_life')}, {r('z', 'spread_zscore')}, {r('tau', 'kendall_tau')}, {r('rho', 'spearman_rho')}, {r('lo', 'lower_tail_dependence')}, {r('hi', 'upper_tail_dependence')}, {r('hi - lo', 'tail_asymmetry')}
FROM en JOIN te USING ({_PK}) JOIN mi USING ({_PK}) JOIN kl USING ({_PK}) JOIN ct USING ({_PK}) JOIN ta USING ({_PK}) JOIN tl2 USING ({_PK})""")
def q_flow_measures(spark, sf_dir):
    """Without causality by regressions, warping and the choice of a family."""
    made = P.information_flow(obs_items(spark, sf_dir))
    return made.withColumn("half_life", F.when(F.col("half_life") < float("inf"), F.col("half_life"))).select("cohort", "signal_a", "signal_b", "n_samples", *_DEP)
