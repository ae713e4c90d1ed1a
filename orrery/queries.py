"""Registered queries of the engine and the SQL that checks them.

Inputs are observations made of the test tables: ``events`` (five event types as signals
of eight groups of users) and ``lineitem`` (four measures as aligned sensors of twelve
machines).  Doubles are rounded on both sides: sums of floats depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import breaks as B
from .operators import discrete as DI
from .operators import dynamics as D
from .operators import features as FE
from .operators import fleet as L
from .operators import geometry as G
from .operators import local as LO
from .operators import normalisation as N
from .operators import pairwise as P
from .operators import segments as SG
from .operators import sql_engines as S
from .operators import state as ST
from .operators import typology as T
from .operators.signal_vector import rolling, signal_vector, window_features
from .operators.windows import SIGNAL, arrays, spread
from .sources.observations import event_observations, impute_mean, interpolate, lineitem_observations, lineitem_wide, pivot, select, signal_ids
from .sources.validation import drop_constant_signals, validate_observations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

W, STEP = 32, 16
SENSORS = ["d", "p", "q", "t"]
#: Added before rounding, so that a value just between two steps falls alike in both engines.
NUDGE = 1e-7
SHAPE = ["kurtosis", "skewness", "crest_factor"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_events(spark: SparkSession, sf_dir: str, even: bool = True) -> DataFrame:
    return event_observations(_table(spark, sf_dir, "events"), even=even)


def obs_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_observations(_table(spark, sf_dir, "lineitem"))


def wide_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_wide(_table(spark, sf_dir, "lineitem"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def query(name: str, sql: str | None = None, digits: int | None = 4):
    def add(fn: Query) -> Query:
        QUERIES[name] = (lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)) if digits is not None else fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def r(expression: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {name}"


EVENTS = """ev AS (SELECT CAST(user_id % 8 AS VARCHAR) AS cohort, event_type AS signal_id,
  CAST(row_number() OVER (PARTITION BY user_id % 8, event_type ORDER BY event_id) - 1 AS DOUBLE) AS signal_0, CAST(value AS DOUBLE) AS value FROM events)"""
WIDE = """wide AS (SELECT l_returnflag || '_' || CAST(l_suppkey % 4 AS VARCHAR) AS cohort,
  CAST(row_number() OVER (PARTITION BY l_returnflag, l_suppkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS DOUBLE) AS signal_0,
  CAST(l_quantity AS DOUBLE) + 0.0 AS q, CAST(l_extendedprice AS DOUBLE) + 0.0 AS p, CAST(l_discount AS DOUBLE) + 0.0 AS d, CAST(l_tax AS DOUBLE) + 0.0 AS t FROM lineitem)"""
ITEMS = WIDE + """, li AS (
  SELECT cohort, 'q' AS signal_id, signal_0, q AS value FROM wide UNION ALL SELECT cohort, 'p', signal_0, p FROM wide
  UNION ALL SELECT cohort, 'd', signal_0, d FROM wide UNION ALL SELECT cohort, 't', signal_0, t FROM wide)"""

# ---- sources -------------------------------------------------------------------------


@query("unpivot", f"WITH {ITEMS} SELECT cohort, signal_id, count(*) AS n, {r('sum(value)', 'total', 2)}, {r('max(signal_0)', 'last', 2)} FROM li GROUP BY ALL", 2)
def q_unpivot(spark, sf_dir):
    return obs_items(spark, sf_dir).groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("signal_0").alias("last"))


@query("pivot", f"WITH {WIDE} SELECT cohort, {r('signal_0', 'signal_0')}, {', '.join(r(s, s) for s in SENSORS)} FROM wide")
def q_pivot(spark, sf_dir):
    return pivot(obs_items(spark, sf_dir), SENSORS)


@query("observations_uneven", f"SELECT CAST(user_id % 8 AS VARCHAR) AS cohort, event_type AS signal_id, count(*) AS n, {r('min(epoch_us(ts) / 1e6)', 'first', 3)}, {r('max(epoch_us(ts) / 1e6)', 'last', 3)} FROM events GROUP BY ALL", 3)
def q_uneven(spark, sf_dir):
    return obs_events(spark, sf_dir, even=False).groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.min("signal_0").alias("first"), F.max("signal_0").alias("last"))


@query("validate_observations", f"WITH {EVENTS} SELECT count(*) AS n_rows, count(DISTINCT signal_id) AS n_signals, count(DISTINCT cohort) AS n_cohorts, true AS ok FROM ev", None)
def q_validate(spark, sf_dir):
    report = validate_observations(obs_events(spark, sf_dir))
    return spark.createDataFrame([(report.n_rows, report.n_signals, report.n_cohorts, report.ok)], "n_rows long, n_signals long, n_cohorts long, ok boolean")


@query("drop_constant_signals", f"WITH {ITEMS} SELECT cohort, signal_id, count(*) AS n FROM li WHERE (cohort, signal_id) NOT IN (SELECT cohort, signal_id FROM li GROUP BY ALL HAVING stddev_samp(value) <= 0.05) GROUP BY ALL", None)
def q_constant(spark, sf_dir):
    obs = obs_items(spark, sf_dir)
    typology = S.statistics(obs).select(*SIGNAL, (F.col("std") <= 0.05).alias("is_constant"))
    return drop_constant_signals(obs, typology).groupBy(*SIGNAL).agg(F.count("*").alias("n"))


@query("select_signals", f"WITH {EVENTS} SELECT cohort, signal_id, {r('signal_0', 'signal_0')}, {r('value', 'value')} FROM ev WHERE cohort IN ('1', '4') AND signal_id IN ('click', 'view', 'purchase')")
def q_select(spark, sf_dir):
    return select(obs_events(spark, sf_dir), ["1", "4"], ["click", "view", "purchase"])


_GAPS = f"""{EVENTS}, ga AS (SELECT cohort, signal_id, signal_0, CASE WHEN (CAST(signal_0 AS BIGINT) * 7 + CAST(signal_0 AS BIGINT) // 5) % 4 <> 0 THEN value END AS v FROM ev)"""


def _with_gaps(obs: DataFrame) -> DataFrame:
    """About a quarter of the values missing, alone and in runs."""
    i = F.col("signal_0").cast("long")
    return obs.withColumn("value", F.when((i * 7 + F.floor(i / 5)) % 4 != 0, F.col("value")))


@query("interpolate_missing", f"""WITH {_GAPS}, nb AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN signal_0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0, min(CASE WHEN v IS NOT NULL THEN signal_0 END) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1 FROM ga WINDOW o AS (PARTITION BY cohort, signal_id ORDER BY signal_0))
SELECT n.cohort, n.signal_id, {r('n.signal_0', 'signal_0')}, {r('CASE WHEN n.v IS NOT NULL THEN n.v WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (n.signal_0 - s0) / (s1 - s0) END', 'value')} FROM nb n LEFT JOIN ga a ON a.cohort = n.cohort AND a.signal_id = n.signal_id AND a.signal_0 = s0 LEFT JOIN ga b ON b.cohort = n.cohort AND b.signal_id = n.signal_id AND b.signal_0 = s1""")
def q_interpolate(spark, sf_dir):
    return interpolate(_with_gaps(obs_events(spark, sf_dir)))


@query("impute_mean", f"""WITH {WIDE}, ga AS (SELECT cohort, signal_0, {', '.join(f'CASE WHEN CAST(signal_0 AS BIGINT) % {i + 3} <> 1 THEN {c} END AS {c}' for i, c in enumerate(SENSORS))} FROM wide) SELECT cohort, {r('signal_0', 'signal_0')}, {', '.join(r(f'coalesce({c}, avg({c}) OVER ())', c) for c in SENSORS)} FROM ga""")
def q_impute(spark, sf_dir):
    i = F.col("signal_0").cast("long")
    return impute_mean(wide_items(spark, sf_dir).withColumns({c: F.when(i % (k + 3) != 1, F.col(c)) for k, c in enumerate(SENSORS)}), SENSORS)


# ---- relational summaries ------------------------------------------------------------

_STATS = ", ".join(
    [r("avg(value)", "mean"), r("stddev_samp(value)", "std"), r("min(value)", "min"), r("max(value)", "max"), r("max(value) - min(value)", "range"), r("median(value)", "median"), r("quantile_cont(value, 0.25)", "q1"), r("quantile_cont(value, 0.75)", "q3"),
     r("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "iqr"), r("var_samp(value)", "variance"), r("stddev_samp(value) / nullif(abs(avg(value)), 0)", "cv")]
)


@query("statistics", f"WITH {EVENTS} SELECT cohort, signal_id, count(*) AS n_points, {_STATS} FROM ev GROUP BY cohort, signal_id")
def q_statistics(spark, sf_dir):
    return S.statistics(obs_events(spark, sf_dir))


@query("zscore", f"""WITH {EVENTS}, s AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM ev WINDOW w AS (PARTITION BY cohort, signal_id))
SELECT cohort, signal_id, {r('signal_0', 'signal_0')}, {r('value', 'value')}, {r('CASE WHEN sd > 1e-10 THEN (value - m) / sd ELSE 0 END', 'z_score')}, coalesce(sd > 1e-10 AND abs((value - m) / sd) > 3, false) AS is_departure FROM s""")
def q_zscore(spark, sf_dir):
    return S.zscore(obs_events(spark, sf_dir))


_SEVERITY = "CASE WHEN mad <= 1e-10 THEN 'CONSTANT' WHEN abs(score) > 5 THEN 'CRITICAL' WHEN abs(score) > 3.5 THEN 'SEVERE' WHEN abs(score) > 2.5 THEN 'MODERATE' WHEN abs(score) > 2 THEN 'MILD' ELSE 'NORMAL' END AS severity"


@query("mad_departure", f"""WITH {EVENTS}, a AS (SELECT *, median(value) OVER (PARTITION BY cohort, signal_id) AS med FROM ev), b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY cohort, signal_id) AS mad FROM a),
c AS (SELECT *, CASE WHEN mad > 1e-10 THEN 0.6745 * (value - med) / mad ELSE 0 END AS score FROM b)
SELECT cohort, signal_id, {r('signal_0', 'signal_0')}, {r('value', 'value')}, {r('med', 'median_value')}, {r('mad', 'mad_value')}, {r('score', 'mad_score')}, mad > 1e-10 AND abs(score) > 3.5 AS is_departure, {_SEVERITY} FROM c""")
def q_mad(spark, sf_dir):
    return S.mad_departure(obs_events(spark, sf_dir))


@query("rolling_mad_departure", f"""WITH {EVENTS}, a AS (SELECT *, median(value) OVER w AS med FROM ev WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)),
b AS (SELECT *, median(abs(value - med)) OVER w AS mad FROM a WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)), c AS (SELECT *, CASE WHEN mad > 1e-10 THEN 0.6745 * (value - med) / mad ELSE 0 END AS score FROM b)
SELECT cohort, signal_id, {r('signal_0', 'signal_0')}, {r('value', 'value')}, {r('med', 'rolling_median')}, {r('mad', 'rolling_mad')}, {r('score', 'mad_score')}, mad > 1e-10 AND abs(score) > 3.5 AS is_departure FROM c""")
def q_rolling_mad(spark, sf_dir):
    return S.rolling_mad_departure(obs_events(spark, sf_dir))


_JOINED = "pr AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, a.signal_0, a.value AS x, b.value AS y FROM li a JOIN li b ON a.cohort = b.cohort AND a.signal_0 = b.signal_0 AND a.signal_id < b.signal_id)"


@query("correlation", f"WITH {ITEMS}, {_JOINED} SELECT cohort, signal_a, signal_b, {r('corr(x, y)', 'correlation')}, count(*) AS n_points FROM pr GROUP BY ALL HAVING count(*) >= 10")
def q_correlation(spark, sf_dir):
    return S.correlation(obs_items(spark, sf_dir))


# ---- windows -------------------------------------------------------------------------


def _frames(source: str, w: int = W, step: int = STEP) -> str:
    """Window ends with their frame's aggregates, as the framed form defines them."""
    return f"""nu AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0, value) - 1 AS i FROM {source}),
ex AS (SELECT e.cohort, e.signal_id, (e.i - {w - 1}) // {step} AS window_id, e.signal_0 AS signal_0_end, s.signal_0, s.value, s.i FROM nu e JOIN nu s ON e.cohort = s.cohort AND e.signal_id = s.signal_id AND s.i BETWEEN e.i - {w - 1} AND e.i
  WHERE e.i >= {w - 1} AND (e.i - {w - 1}) % {step} = 0),
mo AS (SELECT *, avg(value) OVER g AS m FROM ex WINDOW g AS (PARTITION BY cohort, signal_id, window_id)),
fr AS (SELECT cohort, signal_id, window_id, min(signal_0) AS signal_0_start, max(signal_0_end) AS signal_0_end, count(*) AS n_obs, avg(value) AS mean, stddev_pop(value) AS std, avg(power(value - m, 2)) AS m2, avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4,
  sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, max(value) - min(value) AS peak_to_peak, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2 FROM mo GROUP BY cohort, signal_id, window_id),
wf AS (SELECT cohort, signal_id, window_id, signal_0_start, signal_0_end, (signal_0_start + signal_0_end) / 2 AS signal_0_center, n_obs, mean, std, CASE WHEN m2 > 1e-15 THEN m4 / (m2 * m2) - 3 END AS kurtosis, CASE WHEN m2 > 1e-15 THEN m3 / power(m2, 1.5) END AS skewness,
  CASE WHEN rms > 1e-15 THEN peak / rms END AS crest_factor, rms, peak, peak_to_peak, slope AS trend_slope, CASE WHEN m2 > 1e-15 THEN r2 ELSE 0 END AS trend_r2, sqrt(greatest(m2 * (1 - CASE WHEN m2 > 1e-15 THEN r2 ELSE 0 END), 0)) AS detrend_std,
  peak_to_peak / (abs(mean) + 1e-10) AS pulsation_index, mean AS flow_mean, peak_to_peak AS flow_range FROM fr)"""


_WF = ["mean", "std", "kurtosis", "skewness", "crest_factor", "rms", "peak", "peak_to_peak", "trend_slope", "trend_r2", "detrend_std", "pulsation_index", "flow_mean", "flow_range"]


@query("window_features", f"WITH {EVENTS}, {_frames('ev')} SELECT cohort, signal_id, window_id, {r('signal_0_start', 'signal_0_start')}, {r('signal_0_end', 'signal_0_end')}, {r('signal_0_center', 'signal_0_center')}, n_obs, {', '.join(r(c, c, 3) for c in _WF)} FROM wf", 3)
def q_window_features(spark, sf_dir):
    return window_features(obs_events(spark, sf_dir), W, STEP)


@query("window_arrays", f"""WITH {EVENTS}, {_frames('ev')}, ar AS (SELECT cohort, signal_id, window_id, list(value ORDER BY i) AS y, list(value - m ORDER BY i) AS c FROM mo GROUP BY ALL),
la AS (SELECT cohort, signal_id, window_id, value, m, i, lead(value) OVER g AS v1, lead(value, 2) OVER g AS v2, lag(value) OVER g AS b1, lag(value, 2) OVER g AS b2 FROM mo WINDOW g AS (PARTITION BY cohort, signal_id, window_id ORDER BY i)),
pt AS (SELECT cohort, signal_id, window_id, CAST(value > v1 AS INT) + 2 * CAST(value > v2 AS INT) + 4 * CAST(v1 > v2 AS INT) AS k, count(*) AS c FROM la WHERE v2 IS NOT NULL GROUP BY ALL),
pe AS (SELECT cohort, signal_id, window_id, -sum(c / 30.0 * log2(c / 30.0)) / log2(6) AS permutation_entropy FROM pt GROUP BY ALL)
SELECT cohort, signal_id, window_id, {r('sum((value - m) * (v1 - m)) / sum((value - m) * (value - m))', 'acf_lag1')}, {r('var_samp(value - b2) / (2 * var_samp(value - b1))', 'variance_ratio')}, {r('avg(v1 - value)', 'mean_rate')}, {r('max(v1 - value)', 'max_rate')}, {r('min(v1 - value)', 'min_rate')}, {r('stddev_pop(v1 - value)', 'rate_std')},
{r('max(abs(v1 - value))', 'abs_max_rate')}, CAST(sum(CASE WHEN sign(value - m) <> sign(v1 - m) THEN 1 ELSE 0 END) AS INTEGER) AS mean_crossings, {r('any_value(permutation_entropy)', 'permutation_entropy')} FROM la JOIN pe USING (cohort, signal_id, window_id) GROUP BY cohort, signal_id, window_id""")
def q_window_arrays(spark, sf_dir):
    y = F.col("y")
    rows = spread(arrays(obs_events(spark, sf_dir), W, STEP))
    return rows.select(*SIGNAL, "window_id", C.acf(y, 1).alias("acf_lag1"), C.variance_ratio(y, 2).alias("variance_ratio"), *[v.alias(k) for k, v in C.rates(y).items()], C.zero_crossings(C.centred(y)).alias("mean_crossings"), C.permutation_entropy(y).alias("permutation_entropy"))


_LEVEL = "CASE WHEN nd <= 10 THEN value ELSE (SELECT sum((value > CASE WHEN g.e = 10 THEN hi ELSE lo + (hi - lo) * g.e / 10.0 END)::INT) FROM range(0, 11) AS g(e)) END"


@query("discrete_features", f"""WITH {ITEMS}, {_frames('li')}, lv AS (SELECT cohort, signal_id, window_id, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS nd FROM mo GROUP BY ALL), lb AS (SELECT mo.*, {_LEVEL} AS label FROM mo JOIN lv USING (cohort, signal_id, window_id)),
st AS (SELECT *, lead(label) OVER g AS nx, CASE WHEN value = lag(value) OVER g THEN 0 ELSE 1 END AS starts FROM lb WINDOW g AS (PARTITION BY cohort, signal_id, window_id ORDER BY i)),
rn AS (SELECT *, sum(starts) OVER (PARTITION BY cohort, signal_id, window_id ORDER BY i) AS run FROM st),
rl AS (SELECT cohort, signal_id, window_id, run, count(*) AS len FROM rn GROUP BY ALL), dw AS (SELECT cohort, signal_id, window_id, count(*) AS n_dwells, avg(len) AS dwell_mean, stddev_pop(len) AS dwell_std, max(len) AS dwell_max, min(len) AS dwell_min FROM rl GROUP BY ALL),
sh AS (SELECT cohort, signal_id, window_id, label, count(*) / {W}.0 AS p FROM lb GROUP BY ALL), en AS (SELECT cohort, signal_id, window_id, -sum(p * log2(p)) AS shannon_entropy, count(*) AS n_levels, max(p) AS duty_dominant, max(p) - min(p) AS duty_range FROM sh GROUP BY ALL),
tr AS (SELECT cohort, signal_id, window_id, sum(CASE WHEN nx <> label THEN 1 ELSE 0 END) AS transition_count FROM st WHERE nx IS NOT NULL GROUP BY ALL)
SELECT cohort, signal_id, window_id, {r('shannon_entropy', 'shannon_entropy')}, CAST(n_levels AS INTEGER) AS n_levels, {r('duty_dominant', 'duty_dominant')}, {r('duty_range', 'duty_range')}, CAST(transition_count AS INTEGER) AS transition_count, CAST(n_dwells AS INTEGER) AS n_dwells, {r('dwell_mean', 'dwell_mean')}, {r('dwell_std', 'dwell_std')}, {r('dwell_max', 'dwell_max')}, {r('dwell_min', 'dwell_min')}
FROM en JOIN dw USING (cohort, signal_id, window_id) JOIN tr USING (cohort, signal_id, window_id)""")
def q_discrete(spark, sf_dir):
    made = DI.discrete_features(obs_items(spark, sf_dir), W, STEP)
    return made.select(*SIGNAL, "window_id", "shannon_entropy", "n_levels", "duty_dominant", "duty_range", "transition_count", "n_dwells", "dwell_mean", "dwell_std", "dwell_max", "dwell_min")


_METRICS = ["kurtosis", "trend_r2", "std"]
_TYPO = ", ".join(x for m in _METRICS for x in (r(f"avg({m})", f"{m}_mean", 3), r(f"coalesce(stddev_samp({m}), 0)", f"{m}_std", 3)))


@query("typology_summary", f"WITH {EVENTS}, {_frames('ev')} SELECT cohort, signal_id, count(*) AS n_windows, {_TYPO} FROM wf GROUP BY cohort, signal_id", 3)
def q_typology_summary(spark, sf_dir):
    made = T.summarise(window_features(obs_events(spark, sf_dir), W, STEP), _METRICS)
    return made.select(*SIGNAL, "n_windows", *[f"{m}_{s}" for m in _METRICS for s in ("mean", "std")])


# ---- Gaussian fingerprints -----------------------------------------------------------

_FP = ["kurtosis", "skewness", "trend_r2"]
_PRINTS = f"fp AS (SELECT cohort, signal_id, count(*) AS n_windows, {', '.join(f'avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}' for c in _FP)}, corr(kurtosis, skewness) AS corr_kurtosis_skewness, ({' + '.join(f'coalesce(stddev_samp({c}), 0)' for c in _FP)}) / 3.0 AS fingerprint_volatility FROM wf GROUP BY cohort, signal_id)"


@query("gaussian_fingerprint", f"WITH {EVENTS}, {_frames('ev')}, {_PRINTS} SELECT cohort, signal_id, n_windows, {', '.join(r(f'mean_{c}', f'mean_{c}', 3) + ', ' + r(f'std_{c}', f'std_{c}', 3) for c in _FP)}, {r('corr_kurtosis_skewness', 'corr_kurtosis_skewness', 3)}, {r('fingerprint_volatility', 'fingerprint_volatility', 3)} FROM fp", 3)
def q_gaussian_fingerprint(spark, sf_dir):
    return S.gaussian_fingerprint(window_features(obs_events(spark, sf_dir), W, STEP), _FP)


def _db(c: str) -> str:
    return f"CASE WHEN a.std_{c} > 1e-10 AND b.std_{c} > 1e-10 THEN 0.25 * power(a.mean_{c} - b.mean_{c}, 2) / (power(a.std_{c}, 2) + power(b.std_{c}, 2)) + 0.5 * ln((power(a.std_{c}, 2) + power(b.std_{c}, 2)) / (2 * a.std_{c} * b.std_{c})) END"


@query("gaussian_similarity", f"""WITH {EVENTS}, {_frames('ev')}, {_PRINTS}, pp AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, {', '.join(f'{_db(c)} AS db_{c}' for c in _FP)}, abs(a.fingerprint_volatility - b.fingerprint_volatility) AS volatility_diff FROM fp a JOIN fp b ON a.cohort = b.cohort AND a.signal_id < b.signal_id),
tt AS (SELECT *, {' + '.join(f'coalesce(db_{c}, 0)' for c in _FP)} AS total, CAST({' + '.join(f'(db_{c} IS NOT NULL)::INT' for c in _FP)} AS INTEGER) AS n_features FROM pp)
SELECT cohort, signal_a, signal_b, {', '.join(r(f'db_{c}', f'db_{c}', 3) for c in _FP)}, {r('volatility_diff', 'volatility_diff', 3)}, {r('total', 'bhattacharyya_distance', 3)}, n_features, {r('total / nullif(n_features, 0)', 'normalized_distance', 3)}, {r('exp(-total)', 'similarity', 3)} FROM tt""", 3)
def q_gaussian_similarity(spark, sf_dir):
    return S.gaussian_similarity(S.gaussian_fingerprint(window_features(obs_events(spark, sf_dir), W, STEP), _FP), _FP)


# ---- state and geometry --------------------------------------------------------------

_CENTRE = f"""ce AS (SELECT *, {', '.join(f'avg({c}) OVER g AS c_{c}' for c in SHAPE)} FROM wf WHERE kurtosis IS NOT NULL OR skewness IS NOT NULL OR crest_factor IS NOT NULL WINDOW g AS (PARTITION BY cohort, window_id)),
di AS (SELECT *, sqrt({' + '.join(f'power({c} - c_{c}, 2)' for c in SHAPE)}) AS dd FROM ce)"""


@query("cohort_vector", f"WITH {EVENTS}, {_frames('ev')}, {_CENTRE} SELECT cohort, window_id, {r('min(signal_0_start)', 'signal_0_start', 3)}, {r('max(signal_0_end)', 'signal_0_end', 3)}, {r('avg(signal_0_center)', 'signal_0_center', 3)}, count(*) AS n_signals, {r('CASE WHEN count(dd) >= 2 THEN avg(dd) END', 'mean_distance', 3)}, {r('CASE WHEN count(dd) >= 2 THEN max(dd) END', 'max_distance', 3)}, {r('CASE WHEN count(dd) >= 2 THEN stddev_pop(dd) END', 'std_distance', 3)}, {', '.join(r(f'avg({c})', f'state_shape_{c}', 3) for c in SHAPE)} FROM di GROUP BY cohort, window_id", 3)
def q_cohort_vector(spark, sf_dir):
    return ST.cohort_vector(window_features(obs_events(spark, sf_dir), W, STEP), {"shape": SHAPE})


@query("effective_dimension", f"""WITH {EVENTS}, {_frames('ev')}, cv AS (SELECT cohort, window_id, count(*) AS n_signals, {', '.join(f'covar_samp({a}, {b}) AS {a}__{b}' for a in SHAPE for b in SHAPE)} FROM wf WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SHAPE)} GROUP BY cohort, window_id)
SELECT cohort, window_id, n_signals, {r(' + '.join(f'{c}__{c}' for c in SHAPE), 'total_variance', 3)}, {r('power(' + ' + '.join(f'{c}__{c}' for c in SHAPE) + ', 2) / (' + ' + '.join(f'power({a}__{b}, 2)' for a in SHAPE for b in SHAPE) + ')', 'effective_dim', 3)} FROM cv WHERE n_signals >= 2""", 3)
def q_effective_dim(spark, sf_dir):
    return G.effective_dim(window_features(obs_events(spark, sf_dir), W, STEP), SHAPE)


@query("cohort_pairwise", f"""WITH {EVENTS}, {_frames('ev')}, ok AS (SELECT cohort, window_id, signal_id, {', '.join(f'{c} AS f{i}, avg({c}) OVER g AS c{i}' for i, c in enumerate(SHAPE))} FROM wf WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SHAPE)} WINDOW g AS (PARTITION BY cohort, window_id)),
ra AS (SELECT *, sqrt(power(f0 - c0, 2) + power(f1 - c1, 2) + power(f2 - c2, 2)) AS rr FROM ok), rb AS (SELECT *, avg(rr) OVER (PARTITION BY cohort, window_id) AS mr FROM ra)
SELECT a.cohort, a.window_id, a.signal_id AS signal_a, b.signal_id AS signal_b, {r('sqrt(power(a.f0 - b.f0, 2) + power(a.f1 - b.f1, 2) + power(a.f2 - b.f2, 2))', 'distance', 3)}, {r('(a.f0 * b.f0 + a.f1 * b.f1 + a.f2 * b.f2) / (sqrt(a.f0 * a.f0 + a.f1 * a.f1 + a.f2 * a.f2) * sqrt(b.f0 * b.f0 + b.f1 * b.f1 + b.f2 * b.f2))', 'cosine_similarity', 3)}, {r('abs(a.rr - b.rr)', 'state_distance_diff', 3)}, a.rr < a.mr AND b.rr < a.mr AS both_close_to_state
FROM rb a JOIN rb b ON a.cohort = b.cohort AND a.window_id = b.window_id AND a.signal_id < b.signal_id""", 3)
def q_pairwise(spark, sf_dir):
    made = P.feature_pairs(window_features(obs_events(spark, sf_dir), W, STEP), "shape", SHAPE)
    return made.select("cohort", "window_id", "signal_a", "signal_b", "distance", "cosine_similarity", "state_distance_diff", "both_close_to_state")


def _vector(spark, sf_dir, window: int = 64, stride: int = 32) -> DataFrame:
    return signal_vector(obs_events(spark, sf_dir), window, stride, ["statistics", "acf_decay", "memory", "complexity", "spectral", "trend"])


@query("signal_vector")
def q_signal_vector(spark, sf_dir):
    return signal_vector(obs_events(spark, sf_dir), 64, 32)


@query("typology_windows")
def q_typology_windows(spark, sf_dir):
    return T.typology_windows(obs_events(spark, sf_dir), 64, 32)


@query("breaks")
def q_breaks(spark, sf_dir):
    return B.breaks(obs_events(spark, sf_dir), 1.0)


@query("break_summary")
def q_break_summary(spark, sf_dir):
    return B.break_summary(B.breaks(obs_events(spark, sf_dir), 1.0))


@query("trajectory_views")
def q_views(spark, sf_dir):
    return ST.trajectory_views(_vector(spark, sf_dir, 32, 16), SHAPE)


@query("laplacian_view")
def q_laplacian(spark, sf_dir):
    return ST.laplacian_view(_vector(spark, sf_dir, 32, 16), SHAPE)


def _geometry(spark, sf_dir) -> dict[str, DataFrame]:
    return G.cohort_geometry(window_features(obs_events(spark, sf_dir), W, STEP), {"shape": SHAPE, "trend": ["trend_slope", "trend_r2", "detrend_std"]})


@query("cohort_geometry")
def q_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir)["geometry"]


@query("cohort_signal_positions")
def q_positions(spark, sf_dir):
    return _geometry(spark, sf_dir)["positions"]


@query("cohort_feature_loadings")
def q_loadings(spark, sf_dir):
    return _geometry(spark, sf_dir)["loadings"]


@query("signal_dominance")
def q_dominance(spark, sf_dir):
    return G.signal_dominance(_geometry(spark, sf_dir)["positions"])


@query("signal_geometry")
def q_signal_geometry(spark, sf_dir):
    rows = window_features(obs_events(spark, sf_dir), W, STEP)
    return G.signal_geometry(rows, _geometry(spark, sf_dir)["loadings"], ST.cohort_vector(rows, {"shape": SHAPE}), "shape", SHAPE)


# ---- dynamics ------------------------------------------------------------------------


@query("geometry_dynamics")
def q_geometry_dynamics(spark, sf_dir):
    return D.geometry_dynamics(_geometry(spark, sf_dir)["geometry"])


_ED = f"""cv AS (SELECT cohort, window_id, max(signal_0_end) AS s, count(*) AS n_signals, {', '.join(f'covar_samp({a}, {b}) AS {a}__{b}' for a in SHAPE for b in SHAPE)} FROM wf WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SHAPE)} GROUP BY cohort, window_id),
ed AS (SELECT cohort, s, power({' + '.join(f'{c}__{c}' for c in SHAPE)}, 2) / ({' + '.join(f'power({a}__{b}, 2)' for a in SHAPE for b in SHAPE)}) AS e FROM cv WHERE n_signals >= 2)"""


def _gradient_sql(y: str) -> str:
    b, f, hs, hd = f"lag({y}) OVER o", f"lead({y}) OVER o", "(s - lag(s) OVER o)", "(lead(s) OVER o - s)"
    return f"CASE WHEN {b} IS NULL THEN ({f} - {y}) / {hd} WHEN {f} IS NULL THEN ({y} - {b}) / {hs} ELSE ({hs} * {hs} * {f} + ({hd} * {hd} - {hs} * {hs}) * {y} - {hd} * {hd} * {b}) / ({hs} * {hd} * ({hs} + {hd})) END"


@query("dimension_dynamics", f"""WITH {EVENTS}, {_frames('ev')}, {_ED}, sm AS (SELECT *, (coalesce(lag(e) OVER o, 0) + e + coalesce(lead(e) OVER o, 0)) / 3 AS z FROM ed WINDOW o AS (PARTITION BY cohort ORDER BY s)),
ve AS (SELECT *, {_gradient_sql('z')} AS v FROM sm WINDOW o AS (PARTITION BY cohort ORDER BY s)), ac AS (SELECT *, {_gradient_sql('v')} AS a FROM ve WINDOW o AS (PARTITION BY cohort ORDER BY s)), je AS (SELECT *, {_gradient_sql('a')} AS j FROM ac WINDOW o AS (PARTITION BY cohort ORDER BY s))
SELECT cohort, {r('s', 'signal_0_end')}, {r('e', 'effective_dim')}, {r('v', 'effective_dim_velocity')}, {r('a', 'effective_dim_acceleration')}, {r('j', 'effective_dim_jerk')}, {r('abs(a) / power(1 + v * v, 1.5)', 'effective_dim_curvature')} FROM je""")
def q_dimension_dynamics(spark, sf_dir):
    rows = window_features(obs_events(spark, sf_dir), W, STEP)
    ends = rows.groupBy("cohort", "window_id").agg(F.max("signal_0_end").alias("signal_0_end"))
    made = G.effective_dim(rows, SHAPE).join(ends, ["cohort", "window_id"]).withColumns({"engine": F.lit("shape"), "eigenvalue_1": F.lit(0.0)})
    got = D.geometry_dynamics(made)
    return got.select("cohort", "signal_0_end", "effective_dim", "effective_dim_velocity", "effective_dim_acceleration", "effective_dim_jerk", "effective_dim_curvature")


@query("rolling_engine")
def q_rolling(spark, sf_dir):
    return rolling(obs_events(spark, sf_dir), "statistics", 16)


@query("exponent_trend")
def q_exponent_trend(spark, sf_dir):
    return D.exponent_trend(D.ftle_rolling(obs_events(spark, sf_dir), 100, 20))


@query("kendall_trend")
def q_kendall_trend(spark, sf_dir):
    return D.kendall_trend(window_features(obs_events(spark, sf_dir), W, STEP), "std")


@query("basins")
def q_basins(spark, sf_dir):
    rows = window_features(obs_items(spark, sf_dir), 64, 64)
    return L.basins(G.cohort_geometry(rows, {"shape": SHAPE}, False)["geometry"])


@query("thermodynamics")
def q_thermodynamics(spark, sf_dir):
    return D.thermodynamics(_geometry(spark, sf_dir)["geometry"])


_VELOCITY = """z AS (SELECT cohort, signal_id, signal_0, CASE WHEN stddev_pop(value) OVER g > 1e-10 THEN (value - avg(value) OVER g) / stddev_pop(value) OVER g ELSE 0 END AS x FROM li WINDOW g AS (PARTITION BY cohort, signal_id)),
v AS (SELECT *, x - lag(x) OVER o AS vel FROM z WINDOW o AS (PARTITION BY cohort, signal_id ORDER BY signal_0)), a AS (SELECT *, vel - lag(vel) OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS acc FROM v),
s AS (SELECT cohort, signal_0, sum(vel * vel) AS vv, sum(acc * acc) AS aa, sum(vel * acc) AS va, sum(CASE WHEN vel <> 0 THEN vel * vel * ln(vel * vel) ELSE 0 END) AS vlv, max(vel * vel) AS top FROM a WHERE vel IS NOT NULL GROUP BY cohort, signal_0)"""


@query("velocity_field", f"WITH {ITEMS}, {_VELOCITY} SELECT cohort, {r('signal_0', 'signal_0', 3)}, {r('sqrt(vv)', 'speed', 3)}, {r('sqrt(aa)', 'acceleration_magnitude', 3)}, {r('va / sqrt(nullif(vv, 0))', 'acceleration_parallel', 3)}, {r('top / nullif(vv, 0)', 'dominant_motion_fraction', 3)}, {r('CASE WHEN vv > 0 THEN exp(ln(vv) - vlv / vv) END', 'motion_dimensionality', 3)} FROM s", 3)
def q_velocity(spark, sf_dir):
    made = D.velocity_field(D.velocity_components(obs_items(spark, sf_dir)))
    return made.select("cohort", "signal_0", "speed", "acceleration_magnitude", "acceleration_parallel", "dominant_motion_fraction", "motion_dimensionality")


@query("velocity_components", f"WITH {ITEMS}, {_VELOCITY} SELECT cohort, signal_id, {r('signal_0', 'signal_0', 3)}, {r('vel', 'velocity', 3)}, {r('acc', 'acceleration', 3)} FROM a WHERE vel IS NOT NULL", 3)
def q_velocity_components(spark, sf_dir):
    return D.velocity_components(obs_items(spark, sf_dir))


@query("gradient_uneven", f"""WITH e AS (SELECT CAST(user_id % 8 AS VARCHAR) AS cohort, event_type AS signal_id, epoch_us(ts) / 1e6 AS s, CAST(value AS DOUBLE) AS y FROM events), l AS (SELECT *, lag(y) OVER o AS b, lead(y) OVER o AS f, greatest(s - lag(s) OVER o, 1e-12) AS hs, greatest(lead(s) OVER o - s, 1e-12) AS hd FROM e WINDOW o AS (PARTITION BY cohort, signal_id ORDER BY s))
SELECT cohort, signal_id, {r('s', 'signal_0', 3)}, {r('CASE WHEN b IS NULL AND f IS NULL THEN NULL WHEN b IS NULL THEN (f - y) / hd WHEN f IS NULL THEN (y - b) / hs ELSE (hs * hs * f + (hd * hd - hs * hs) * y - hd * hd * b) / (hs * hd * (hs + hd)) END', 'gradient', 4)} FROM l""", None)
def q_gradient(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(*SIGNAL).orderBy("signal_0")
    rows = obs_events(spark, sf_dir, even=False).withColumn("gradient", D.gradient("value", "signal_0", w))
    return rows.select(*SIGNAL, (F.round(F.col("signal_0") + NUDGE, 3) + F.lit(0.0)).alias("signal_0"), (F.round(F.col("gradient") + NUDGE, 4) + F.lit(0.0)).alias("gradient"))


@query("ftle")
def q_ftle(spark, sf_dir):
    return D.ftle_bidirectional(obs_events(spark, sf_dir))


@query("ftle_intervention")
def q_ftle_cut(spark, sf_dir):
    return D.ftle(obs_events(spark, sf_dir), intervention=120.0)


@query("lyapunov")
def q_lyapunov(spark, sf_dir):
    return D.lyapunov(obs_events(spark, sf_dir))


@query("lyapunov_kantz")
def q_lyapunov_kantz(spark, sf_dir):
    return D.lyapunov(obs_events(spark, sf_dir), method="kantz")


@query("lyapunov_rolling")
def q_lyapunov_rolling(spark, sf_dir):
    return D.lyapunov_rolling(obs_events(spark, sf_dir), 200, 50)


@query("lyapunov_trend")
def q_lyapunov_trend(spark, sf_dir):
    return D.exponent_trend(D.lyapunov_rolling(obs_events(spark, sf_dir), 100, 20), "lyapunov")


@query("ftle_rolling")
def q_ftle_rolling(spark, sf_dir):
    return D.ftle_rolling(obs_events(spark, sf_dir), 100, 50)


@query("ridge_proximity")
def q_ridge(spark, sf_dir):
    obs = obs_events(spark, sf_dir)
    return D.ridge_proximity(D.ftle_rolling(obs, 100, 20), D.velocity_field(D.velocity_components(obs)))


@query("signal_stability", digits=3)
def q_stability(spark, sf_dir):
    return D.signal_stability(obs_events(spark, sf_dir))


@query("persistent_homology")
def q_homology(spark, sf_dir):
    vector = ST.cohort_vector(window_features(obs_events(spark, sf_dir), 32, 8), {"shape": SHAPE})
    return D.persistent_homology(vector, 12, 4)


@query("critical_slowing_down")
def q_csd(spark, sf_dir):
    return D.critical_slowing_down(obs_events(spark, sf_dir))


@query("saddle_detection")
def q_saddle(spark, sf_dir):
    return LO.saddle_detection(obs_events(spark, sf_dir))


@query("saddle_rolling")
def q_saddle_rolling(spark, sf_dir):
    return LO.saddle_rolling(obs_events(spark, sf_dir), 100, 50)


def _states(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    return ST.cohort_vector(window_features(obs_events(spark, sf_dir), W, 8), {"shape": SHAPE}), [f"state_shape_{c}" for c in SHAPE]


@query("saddle_multivariate")
def q_saddle_multivariate(spark, sf_dir):
    return LO.saddle_multivariate(*_states(spark, sf_dir))


@query("recurrence_measures")
def q_recurrence(spark, sf_dir):
    return LO.recurrence_measures(*_states(spark, sf_dir))


@query("sensitivity_of_vector")
def q_sensitivity_of_vector(spark, sf_dir):
    obs = obs_events(spark, sf_dir)
    return LO.sensitivity_of_vector(window_features(obs, W, 8), "std", signal_ids(obs))


@query("trajectory_sensitivity")
def q_sensitivity(spark, sf_dir):
    return LO.trajectory_sensitivity(wide_items(spark, sf_dir), SENSORS)


# ---- pairs ---------------------------------------------------------------------------


@query("pair_correlations", f"""WITH {ITEMS}, {_JOINED}, rk AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_a, signal_b ORDER BY x, signal_0) AS rx, row_number() OVER (PARTITION BY cohort, signal_a, signal_b ORDER BY y, signal_0) AS ry FROM pr)
SELECT cohort, signal_a, signal_b, {r('corr(x, y)', 'pearson')}, {r('corr(rx, ry)', 'spearman')}, count(*) AS n FROM rk GROUP BY cohort, signal_a, signal_b""")
def q_pair_correlations(spark, sf_dir):
    return P.correlations(P.aligned(obs_items(spark, sf_dir)))


_LAGS = range(-10, 11)
_XCORR = f"""WITH {ITEMS}, {_JOINED}, sh AS (SELECT cohort, signal_a, signal_b, x, {', '.join(f"{'lead' if k > 0 else 'lag'}(y, {abs(k)}) OVER o AS y{i}" for i, k in enumerate(_LAGS))} FROM pr WINDOW o AS (PARTITION BY cohort, signal_a, signal_b ORDER BY signal_0)),
cc AS (SELECT cohort, signal_a, signal_b, count(*) AS n, {', '.join(f'corr(x, y{i}) AS c{i}' for i in range(21))} FROM sh GROUP BY cohort, signal_a, signal_b), un AS ({' UNION ALL '.join(f'SELECT cohort, signal_a, signal_b, n, c{i} AS c, {k} AS lag FROM cc' for i, k in enumerate(_LAGS))}),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_a, signal_b ORDER BY abs(c) DESC, abs(lag), lag DESC) AS k FROM un)
SELECT cohort, signal_a, signal_b, {r('c', 'max_xcorr')}, CAST(lag AS INTEGER) AS lag_at_max, n FROM rk WHERE k = 1 AND n >= 60"""


@query("cross_correlation", _XCORR)
def q_xcorr(spark, sf_dir):
    return P.cross_correlation(P.aligned(obs_items(spark, sf_dir)))


_BIN = "CAST(least(coalesce(floor((%s - min(%s) OVER g) / nullif(max(%s) OVER g - min(%s) OVER g, 0) * 10), 0), 9) AS INT)"


@query("mutual_information", f"""WITH {ITEMS}, {_JOINED}, bi AS (SELECT cohort, signal_a, signal_b, {_BIN % (('x',) * 4)} AS i, {_BIN % (('y',) * 4)} AS j FROM pr WINDOW g AS (PARTITION BY cohort, signal_a, signal_b)),
c1 AS (SELECT cohort, signal_a, signal_b, i, j, count(*) * 1.0 AS c FROM bi GROUP BY ALL), c2 AS (SELECT *, sum(c) OVER (PARTITION BY cohort, signal_a, signal_b) AS n, sum(c) OVER (PARTITION BY cohort, signal_a, signal_b, i) AS ci, sum(c) OVER (PARTITION BY cohort, signal_a, signal_b, j) AS cj FROM c1),
mm AS (SELECT cohort, signal_a, signal_b, max(n) AS n, sum(c / n * ln(c * n / (ci * cj))) AS mi, -sum(c / n * ln(ci / n)) AS hx, -sum(c / n * ln(cj / n)) AS hy FROM c2 GROUP BY ALL)
SELECT cohort, signal_a, signal_b, {r('greatest(mi, 0)', 'mutual_info')}, {r('greatest(mi, 0) / sqrt(hx * hy)', 'normalized_mi')}, CAST(n AS BIGINT) AS n FROM mm""")
def q_mi(spark, sf_dir):
    return P.mutual_information(P.aligned(obs_items(spark, sf_dir)))


_KL = "sum(CASE WHEN {a} > 0 THEN {a} * ln(({a} + 1e-10) / ({b} + 1e-10)) ELSE 0 END)"


@query("divergences", f"""WITH {EVENTS}, en AS (SELECT cohort, signal_id, min(value) AS lo, max(value) AS hi FROM ev GROUP BY ALL), pq AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi FROM en a JOIN en b ON a.cohort = b.cohort AND a.signal_id < b.signal_id),
bi AS (SELECT q.cohort, signal_a, signal_b, CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INT) AS i, signal_id = signal_a AS first FROM pq q JOIN ev e ON e.cohort = q.cohort AND e.signal_id IN (signal_a, signal_b)),
cn AS (SELECT cohort, signal_a, signal_b, i, sum(first::INT) * 1.0 AS ca, sum((NOT first)::INT) * 1.0 AS cb FROM bi GROUP BY ALL), pr AS (SELECT *, ca / sum(ca) OVER g AS p, cb / sum(cb) OVER g AS q FROM cn WINDOW g AS (PARTITION BY cohort, signal_a, signal_b)), mm AS (SELECT *, (p + q) / 2 AS m FROM pr)
SELECT cohort, signal_a, signal_b, {r(_KL.format(a='p', b='q'), 'kl_divergence_a_to_b')}, {r(_KL.format(a='q', b='p'), 'kl_divergence_b_to_a')}, {r('0.5 * ' + _KL.format(a='p', b='m') + ' + 0.5 * ' + _KL.format(a='q', b='m'), 'js_divergence')} FROM mm GROUP BY cohort, signal_a, signal_b""")
def q_divergences(spark, sf_dir):
    return P.divergences(obs_events(spark, sf_dir))


@query("information_flow")
def q_flow(spark, sf_dir):
    return P.information_flow(obs_items(spark, sf_dir))


@query("information_flow_gated")
def q_flow_gated(spark, sf_dir):
    """Of the pairs alone that load on a window's first direction together."""
    obs = obs_items(spark, sf_dir)
    rows = window_features(obs, 64, 64)
    positions = G.cohort_geometry(rows, {"shape": SHAPE}, False)["positions"]
    return P.information_flow(obs, P.feature_pairs(rows, "shape", SHAPE, positions, threshold=1.0).where("needs_granger"))


# ---- fleet ---------------------------------------------------------------------------


def _fleet(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    wide = L.pivot_geometry(_geometry(spark, sf_dir)["geometry"], ("shape", "trend"))
    return wide, ["shape_effective_dim", "trend_effective_dim"]


@query("pivot_geometry")
def q_fleet_pivot(spark, sf_dir):
    return _fleet(spark, sf_dir)[0]


@query("system_vector")
def q_system_vector(spark, sf_dir):
    wide, own = _fleet(spark, sf_dir)
    return L.system_vector(wide, own)


@query("system_geometry")
def q_system_geometry(spark, sf_dir):
    wide, own = _fleet(spark, sf_dir)
    return L.system_geometry(wide, own)["geometry"]


@query("system_pairwise")
def q_system_pairwise(spark, sf_dir):
    wide, own = _fleet(spark, sf_dir)
    return L.system_pairwise(wide, own, L.system_geometry(wide, own)["positions"])


@query("system_information_flow")
def q_system_flow(spark, sf_dir):
    return L.system_information_flow(_fleet(spark, sf_dir)[0], least=10)


@query("system_ftle")
def q_system_ftle(spark, sf_dir):
    return L.system_ftle(_fleet(spark, sf_dir)[0], least=10)


@query("system_velocity_field", digits=2)
def q_system_velocity(spark, sf_dir):
    wide, own = _fleet(spark, sf_dir)
    return L.system_velocity_field(wide, own)


def _signatures(spark, sf_dir, engine: str = "shape") -> DataFrame:
    geometry = _geometry(spark, sf_dir)["geometry"]
    velocity = D.velocity_field(D.velocity_components(obs_events(spark, sf_dir)))
    return L.trajectory_signatures(geometry, D.geometry_dynamics(geometry), velocity, engine)


@query("trajectory_signatures", digits=3)
def q_signatures(spark, sf_dir):
    return _signatures(spark, sf_dir)


@query("trajectory_library")
def q_library(spark, sf_dir):
    return L.trajectory_library(_signatures(spark, sf_dir))["library"]


@query("trajectory_match")
def q_match(spark, sf_dir):
    return L.trajectory_library(_signatures(spark, sf_dir))["match"]


@query("ftle_field")
def q_field(spark, sf_dir):
    rows = window_features(obs_items(spark, sf_dir), 64, 64)
    return L.ftle_field(G.cohort_geometry(rows, {"shape": SHAPE}, False)["geometry"])


# ---- segments and baselines ----------------------------------------------------------

_SEGMENTS: list[SG.Segment] = [("early", 0.0, 99.0), ("late", 100.0, None)]


@query("segments", f"WITH {WIDE} SELECT cohort, CASE WHEN signal_0 <= 99 THEN 'early' ELSE 'late' END AS segment, count(*) AS n, {r('avg(q)', 'mean_q')} FROM wide GROUP BY ALL")
def q_segments(spark, sf_dir):
    return SG.in_segments(wide_items(spark, sf_dir), _SEGMENTS).groupBy("cohort", "segment").agg(F.count("*").alias("n"), F.avg("q").alias("mean_q"))


@query("segment_comparison")
def q_segment_comparison(spark, sf_dir):
    return SG.segment_comparison(wide_items(spark, sf_dir), SENSORS, _SEGMENTS)


@query("info_flow_delta")
def q_flow_delta(spark, sf_dir):
    return SG.info_flow_delta(obs_items(spark, sf_dir), _SEGMENTS)


@query("sensor_eigendecomp")
def q_sensor_eigen(spark, sf_dir):
    return SG.sensor_eigendecomp(wide_items(spark, sf_dir), SENSORS)


@query("cohort_baseline")
def q_baseline(spark, sf_dir):
    return SG.cohort_baseline(wide_items(spark, sf_dir), SENSORS).drop("centroid", "std", "principal_directions", "centroid_json", "std_json", "principal_directions_json")


@query("observation_geometry")
def q_observation_geometry(spark, sf_dir):
    wide = wide_items(spark, sf_dir)
    return SG.observation_geometry(wide, SG.cohort_baseline(wide, SENSORS), SENSORS)


# ---- normalisers and features --------------------------------------------------------


@query("normalise_robust", f"WITH {EVENTS}, g AS (SELECT cohort, signal_id, median(value) AS c, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM ev GROUP BY ALL) SELECT cohort, signal_id, {r('signal_0', 'signal_0')}, {r('(value - c) / CASE WHEN s > 1e-10 THEN s ELSE 1 END', 'value')} FROM ev JOIN g USING (cohort, signal_id)")
def q_normalise(spark, sf_dir):
    obs = obs_events(spark, sf_dir)
    return N.normalise(obs, N.parameters(obs, "robust"))


@query("normalise_parameters", f"WITH {EVENTS} SELECT cohort, signal_id, {r('avg(value)', 'zscore_centre')}, {r('stddev_pop(value)', 'zscore_scale')}, {r('min(value)', 'minmax_centre')}, {r('max(value) - min(value)', 'minmax_scale')} FROM ev GROUP BY ALL")
def q_parameters(spark, sf_dir):
    obs = obs_events(spark, sf_dir)
    z, m = (N.parameters(obs, k).select(*SIGNAL, F.col("centre").alias(f"{k}_centre"), F.col("scale").alias(f"{k}_scale")) for k in ("zscore", "minmax"))
    return z.join(m, SIGNAL)


@query("recommend_normaliser", f"""WITH {EVENTS}, q AS (SELECT cohort, signal_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m FROM ev GROUP BY ALL),
f AS (SELECT cohort, signal_id, sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) / count(*) AS o, kurtosis_pop(value) AS k, avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5) AS s FROM ev JOIN q USING (cohort, signal_id) GROUP BY ALL)
SELECT cohort, signal_id, {r('o', 'outlier_fraction')}, {r('k', 'kurtosis')}, {r('s', 'skewness')}, CASE WHEN o > 0.05 OR k > 10 THEN 'mad' WHEN k > 3 OR abs(s) > 1 THEN 'robust' ELSE 'zscore' END AS method FROM f""")
def q_recommend(spark, sf_dir):
    return N.recommend(obs_events(spark, sf_dir))


_CURVES = f"""cu AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY cohort, signal_id) AS n, value - lag(value) OVER o AS vel FROM ev WINDOW o AS (PARTITION BY cohort, signal_id ORDER BY signal_0)), cb AS (SELECT *, vel - lag(vel) OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS acc, greatest(floor(n / 3), 1) AS k FROM cu)
SELECT cohort, signal_id, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min_by(value, i)', 'first')}, {r('max_by(value, i)', 'last')}, {r('regr_slope(value, i)', 'slope')}, {r('avg(CASE WHEN i < k THEN value END)', 'early_mean')}, {r('avg(CASE WHEN i >= n - k THEN value END)', 'late_mean')}, {r('avg(vel)', 'vel_mean')}, {r('stddev_pop(vel)', 'vel_std')}, {r('avg(acc)', 'acc_mean')}, {r('avg(abs(acc) / power(1 + vel * vel, 1.5))', 'curvature_mean')} FROM cb GROUP BY cohort, signal_id"""


@query("curve_features", f"WITH {EVENTS}, {_CURVES}")
def q_curves(spark, sf_dir):
    made = FE.curve_features(obs_events(spark, sf_dir), SIGNAL, "value", "signal_0")
    return made.select(*SIGNAL, "mean", "std", "first", "last", "slope", "early_mean", "late_mean", "vel_mean", "vel_std", "acc_mean", "curvature_mean")


@query("fingerprint_matrix")
def q_fingerprint_matrix(spark, sf_dir):
    return FE.fingerprint_matrix(FE.cohort_windows(wide_items(spark, sf_dir), SENSORS))


@query("trajectory_features", digits=3)
def q_trajectory_features(spark, sf_dir):
    return FE.single_axis_features(_signatures(spark, sf_dir), "shape")


@query("sub_window_features", digits=3)
def q_sub_window(spark, sf_dir):
    return FE.sub_window_features(_geometry(spark, sf_dir)["geometry"], "shape")


@query("cross_axis_features", digits=3)
def q_cross_axis(spark, sf_dir):
    axes = ["shape", "trend"]
    one, two = (FE.single_axis_features(_signatures(spark, sf_dir, a), a) for a in axes)
    return FE.cross_axis_features(one.join(two, "cohort"), axes)


@query("feature_matrix")
def q_feature_matrix(spark, sf_dir):
    obs = obs_events(spark, sf_dir)
    curves = FE.signal_curves(obs, signal_ids(obs))
    return FE.feature_matrix([curves, FE.sub_window_features(_geometry(spark, sf_dir)["geometry"], "shape")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 rows to cohorts' state and effective dimension."""
    rows = window_features(obs_events(spark, sf_dir), 16, 4)
    return ST.cohort_vector(rows, {"shape": SHAPE}).join(G.effective_dim(rows, SHAPE).drop("n_signals"), ["cohort", "window_id"])
