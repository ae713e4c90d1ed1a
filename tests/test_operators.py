"""Operators on Spark: against kernels, invariances, and every query on the small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import chain_queries, engine_queries  # noqa: F401 (they register queries and SQL)
from orrery import queries as Q
from orrery.functions import columns as C
from orrery.functions import kernels as K
from orrery.operators import discrete, dynamics, local, normalisation, pairwise, segments
from orrery.operators.breaks import breaks
from orrery.operators.signal_vector import signal_vector, window_features, window_size
from orrery.operators.typology import metrics
from orrery.operators.windows import arrays
from orrery.sources.manifest import Config, Gate, Manifest, deep_merge, parse_manifest
from orrery.sources.observations import cmapss_observations, interpolate, read_cmapss
from orrery.sources.tables import read_table, units_of, write_sidecar, write_table
from orrery.sources.validation import drop_dead_columns, finite_or_null, validate_manifest, validate_observations

OBS = "cohort string, signal_id string, signal_0 double, value double"


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(42)
    rows = [(f"c{c}", f"s{s}", float(t), float(v)) for c in range(2) for s in range(3) for t, v in enumerate(rng.normal(size=150).cumsum())]
    return spark.createDataFrame(rows, OBS)


def _series(obs, cohort="c0", signal="s0"):
    return np.array([r["value"] for r in obs.where(f"cohort = '{cohort}' and signal_id = '{signal}'").orderBy("signal_0").collect()])


def test_windows_have_their_rows(obs):
    got = {(r["cohort"], r["signal_id"], r["window_id"]): r for r in arrays(obs, 32, 10, 48).collect()}
    y = _series(obs)
    assert len(got) == 6 * 12
    for k in range(12):
        end = 32 + 10 * k
        assert np.allclose(got["c0", "s0", k]["y"], y[max(0, end - 48) : end]) and got["c0", "s0", k]["signal_0_start"] == end - 32
    short = obs.where("signal_0 < 20")
    assert arrays(short, 32, 10).count() == 0 and arrays(short, 32, 10, short="one").count() == 6


def test_numbers_in_blocks(spark, obs):
    """Long signals are numbered in blocks of their axis, ties and short signals included."""
    from orrery.operators.windows import numbered

    ties = spark.range(500).selectExpr("'a' as cohort", "case when id < 3 then 'short' else 'long' end as signal_id", "cast(id div 7 as double) as signal_0", "cast(id % 11 as double) as value")
    for rows in (obs, ties):
        one, two = (sorted(map(str, numbered(rows, blocks=b).select("cohort", "signal_id", "signal_0", "value", "i", "n").collect())) for b in (0, 9))
        assert one == two and one
    one, two = (sorted(map(str, arrays(obs, 16, 8, blocks=b).collect())) for b in (0, 9))
    assert one == two and one


def test_frames_equal_groups(obs):
    """Windows as row frames and as groups, short signals included."""
    from orrery.functions.columns import frame_features
    from orrery.operators.windows import frame, framed, gathered

    for window, stride in ((16, 8), (10, 3), (200, 50)):
        one = framed(obs, window, stride, frame_features(frame(window))).toPandas().sort_values(["cohort", "signal_id", "window_id"]).reset_index(drop=True)
        two = gathered(obs, window, stride, frame_features(None)).toPandas().sort_values(["cohort", "signal_id", "window_id"]).reset_index(drop=True)
        assert list(one.columns) == list(two.columns)
        pd.testing.assert_frame_equal(one, two, rtol=1e-9, atol=1e-9)


def test_frames_equal_kernels(obs):
    got = window_features(obs, 32, 16).where("cohort = 'c0' and signal_id = 's0'").orderBy("window_id").collect()
    y = _series(obs)
    for k, r in enumerate(got):
        w = y[16 * k : 16 * k + 32]
        want = K.shape(w) | K.size(w) | K.trend(w)
        assert all(abs(r[c] - want[c]) < 1e-6 for c in ("kurtosis", "skewness", "crest_factor", "rms", "peak_to_peak", "trend_slope", "trend_r2", "detrend_std"))


def test_array_columns_equal_kernels(obs):
    y = F.col("y")
    rows = arrays(obs, 64, 32).select("y", C.acf(y, 1).alias("acf"), C.permutation_entropy(y).alias("pe"), C.variance_ratio(y, 2).alias("vr"), C.rates(y)["rate_std"].alias("rs")).collect()
    for r in rows:
        w = np.array(r["y"])
        assert abs(r["acf"] - K.memory_decay(w)["acf_lag1"]) < 1e-9 and abs(r["pe"] - K.permutation_entropy(w)) < 1e-9
        assert abs(r["vr"] - K.variance_ratio(w)["variance_ratio"]) < 1e-9 and abs(r["rs"] - K.rate_of_change(w)["rate_std"]) < 1e-9


def test_discrete_equals_kernel(obs):
    levels = obs.withColumn("value", F.round(F.col("value")))
    got = {(r["cohort"], r["signal_id"], r["window_id"]): r for r in discrete.discrete_features(levels, 32, 16).collect()}
    for r in arrays(levels, 32, 16).collect():
        w = np.array(r["y"])
        if len(np.unique(w)) <= 10:
            want, g = K.discrete(w), got[r["cohort"], r["signal_id"], r["window_id"]]
            assert abs(g["shannon_entropy"] - want["shannon_entropy"]) < 1e-9 and g["transition_count"] == want["transition_count"] and abs(g["dwell_mean"] - want["dwell_mean"]) < 1e-9


def test_row_order_and_partitions_do_not_matter(obs):
    columns = ["cohort", "signal_id", "window_id", "kurtosis", "hurst"]
    a, b = (sorted(map(tuple, signal_vector(o, 64, 32, ["statistics", "memory"]).select(*columns).collect())) for o in (obs, obs.orderBy(F.desc("value")).repartition(7)))
    assert a == b and len(a) == 6 * 3


def test_gates(obs):
    m = Manifest(gates=(Gate("memory", "noise", gt=0.5), Gate("statistics", min_n_obs=1000)))
    typology = arrays(obs, 64, 32).select("cohort", "signal_id", "window_id", F.when(F.col("signal_id") == "s0", 1.0).when(F.col("signal_id") == "s1", 0.1).alias("noise"))
    got = signal_vector(obs, 64, 32, ["statistics", "memory"], m, typology).groupBy("signal_id").agg(F.count("hurst").alias("h"), F.count("kurtosis").alias("k")).collect()
    assert {r["signal_id"]: (r["h"], r["k"]) for r in got} == {"s0": (0, 0), "s1": (6, 0), "s2": (6, 0)}


def test_window_sizes():
    assert window_size(16, 4, 256, 2.0) == 32 and window_size(16, 4, 256, 4.0, "sqrt") == 32 and window_size(16, 4, 20, 9.0) == 20


def test_uneven_gradient(spark):
    w = Window.partitionBy("cohort", "signal_id").orderBy("signal_0")
    s = [0.0, 1.0, 3.0, 7.0, 15.0]
    rows = spark.createDataFrame([("c", "s", x, 2 * x) for x in s] + [("c", "q", x, x * x) for x in s], OBS)
    got = rows.withColumn("g", dynamics.gradient("value", "signal_0", w)).orderBy("signal_id", "signal_0").collect()
    assert np.allclose([r["g"] for r in got if r["signal_id"] == "s"], 2)
    assert np.allclose([r["g"] for r in got if r["signal_id"] == "q"], np.gradient(np.square(s), s, edge_order=1))
    v = dynamics.velocity_components(rows.where("signal_id = 's'"), standardise=False).collect()
    assert np.allclose([r["velocity"] for r in v], 2)


def test_breaks_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(size=700), 20 + rng.normal(size=900), 5 + rng.normal(size=700)])
    obs = spark.createDataFrame([("c", "s", float(i), float(v)) for i, v in enumerate(y)], OBS)
    steps = lambda block: {r["index"] for r in breaks(obs, 0.6, block=block).collect() if abs(r["post_level"] - r["pre_level"]) > 8}
    whole = steps(10_000)
    assert {700, 1600} <= {700 if abs(i - 700) < 5 else 1600 if abs(i - 1600) < 5 else i for i in whole}
    assert whole == steps(1000)


def _sensitivity_by_hand(x, horizon=5, k=10):
    v, p = np.diff(x, axis=0), x[:-1]
    n, d = p.shape
    j = []
    for i in range(n):
        near = sorted(range(n), key=lambda m: (((p[m] - p[i]) ** 2).sum(), m))[: max(k, d + 2)]
        j.append(np.linalg.lstsq(p[near] - p[i], v[near] - v[i], rcond=1e-6)[0].T)
    grown = []
    for i in range(n):
        m = np.eye(d)
        for t in range(i, min(i + horizon, n)):
            m = (np.eye(d) + j[t]) @ m
        grown.append(np.sqrt((m**2).sum(0)))
    return np.array(grown)


def test_sensitivity_of_every_window(spark, tmp_path):
    """The query sees whole cohorts, and its numbers are those of brute force."""
    rng = np.random.default_rng(9)
    rows = [(c, i, 4 * i + c, 1, float(a), float(b), float(e), float(f)) for c, n in ((0, 460), (1, 150)) for i, (a, b, e, f) in enumerate(rng.normal(size=(n, 4)).cumsum(0).round(3))]
    names = ("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    spark.createDataFrame([("A", *r) for r in rows], "l_returnflag string, " + ", ".join(f"{c} {'long' if i < 4 else 'double'}" for i, c in enumerate(names))).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["cohort"], r["window_id"], r["signal_id"]): r for r in Q.QUERIES["trajectory_sensitivity"](spark, str(tmp_path)).collect()}
    assert {k[:2] for k in got} == {("A_0", w) for w in range(8)} | {("A_1", w) for w in range(2)}
    series = {c: np.array([(r[6], r[5], r[4], r[7]) for r in rows if r[0] == c]) for c in (0, 1)}  # d, p, q, t
    for c, w in ((0, 0), (0, 7), (1, 1)):
        x = series[c][50 * w : 50 * w + 100]
        want = _sensitivity_by_hand((x - x.mean(0)) / x.std(0))
        for k, s in enumerate(Q.SENSORS):
            r = got[f"A_{c}", w, s]
            assert r["signal_0_end"] == 50 * w + 99 and abs(r["current_sensitivity"] - want[-1, k]) < 1e-3 and abs(r["mean_sensitivity"] - want[:, k].mean()) < 1e-3


def _events(spark, tmp_path, series):
    """An events table of one cohort with these series by type."""
    rows = [(8, k, i, v) for k, y in series.items() for i, v in enumerate(map(float, y))]
    made = spark.createDataFrame(rows, "user_id long, event_type string, event_id long, value double")
    made.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_exponents_of_the_last_2000_rows(spark, tmp_path):
    """As the reference: 2000 rows of at least 200, but before an intervention of 50."""
    rng = np.random.default_rng(10)
    y = rng.normal(size=2300).cumsum()
    sf = _events(spark, tmp_path, {"long": y, "short": rng.normal(size=150)})
    of = lambda name: {(r["signal_id"], r.asDict().get("direction")): r for r in Q.QUERIES[name](spark, sf).collect()}
    want = dynamics._exponent(y[-2000:])
    both, cut, fixed = of("ftle"), of("ftle_intervention"), of("lyapunov")
    for got in (both["long", "forward"], cut["long", "forward"]):
        assert got["n_samples"] == 2000 and got["embedding_tau"] == want[3] and abs(got["ftle"] - want[0]) < 1e-3
    assert both["short", "forward"]["ftle"] is None and both["short", "backward"]["ftle"] is None and fixed["short", None]["lyapunov"] is None
    assert fixed["long", None]["n_samples"] == 2000 and abs(fixed["long", None]["lyapunov"] - dynamics._exponent(y[-2000:], None, 3)[0]) < 1e-3
    r = cut["long", "forward"]
    assert r["n_pre"] == 120 and abs(r["ftle_pre"] - dynamics._exponent(y[:120])[0]) < 1e-3 and r["n_post"] == 2000 and r["ftle_delta"] is not None


def test_saddles_of_whole_series(spark, tmp_path, monkeypatch):
    """Early rows count, and blocks of points change nothing."""
    rng = np.random.default_rng(13)
    y = np.concatenate([rng.normal(size=600), np.linspace(0, 40, 1000) + 1e-3 * rng.normal(size=1000)])
    r = Q.QUERIES["saddle_detection"](spark, _events(spark, tmp_path, {"a": y})).first()
    x = K.embed(y, 3, K.optimal_delay(y))
    monkeypatch.setattr(local, "CELLS", len(x) ** 2)
    whole = local.jacobians(x)[1]
    want = local.saddles(x)
    monkeypatch.setattr(local, "CELLS", 1000)
    assert np.allclose(local.jacobians(x)[1], whole)
    assert r["n_valid"] == len(x) - 1 and all(np.isclose(np.nan if r[c] is None else r[c], want[c], atol=1e-3, equal_nan=True) for c in local.SADDLE)


def test_feature_matrix_has_every_signal(spark, sf_dir):
    rows = Q.obs_events(spark, sf_dir).groupBy("cohort", "signal_id").agg(F.avg("value").alias("m")).collect()
    got = {r["cohort"]: r for r in Q.QUERIES["feature_matrix"](spark, sf_dir).collect()}
    assert len({r["signal_id"] for r in rows}) == 5 and {r["cohort"] for r in rows} <= set(got)
    assert all(abs(got[r["cohort"]][f"{r['signal_id']}_mean"] - r["m"]) < 1e-3 for r in rows)


def test_flow_of_the_last_2000_points(spark, tmp_path):
    rng = np.random.default_rng(11)
    values = rng.normal(size=(2100, 4)).cumsum(0).round(3)
    rows = [("A", 4, i, 1, 1, *map(float, v)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_orderkey long, l_partkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["signal_a"], r["signal_b"]): r for r in Q.QUERIES["information_flow"](spark, str(tmp_path)).collect()}
    assert len(got) == 6 and all(r["n_samples"] == 2000 for r in got.values())
    p, q = values[-2000:, 1], values[-2000:, 0]
    f, r = pairwise.granger(p, q)[0], got["p", "q"]
    assert abs(r["granger_f_a_to_b"] - f) < 1e-3 and abs(r["transfer_entropy_a_to_b"] - pairwise.transfer_entropy(p, q)) < 1e-3 and abs(r["hedge_ratio"] - pairwise.cointegration(p, q)["hedge_ratio"]) < 1e-3


def test_normalisers_invert(obs):
    for method in normalisation.METHODS:
        p = normalisation.parameters(obs, method)
        back = normalisation.denormalise(normalisation.normalise(obs, p), p).withColumnRenamed("value", "v")
        assert back.join(obs, ["cohort", "signal_id", "signal_0"]).where(F.abs(F.col("v") - F.col("value")) > 1e-9).count() == 0


def test_segments_include_their_ends(obs):
    got = segments.in_segments(obs, [("a", 0.0, 9.0), ("b", 10.0, None)]).groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in got} == {"a": 60, "b": 840}


def test_cmapss(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 1 " + " ".join(map(str, range(24))) + "  \n1 2 " + " ".join(map(str, range(20))) + "\n\n")
    wide = read_cmapss(spark, str(tmp_path / "d.txt"))
    long = cmapss_observations(wide)
    assert wide.count() == 2 and long.count() == 21 + 17 and long.agg(F.min("signal_0")).first()[0] == 0


def test_tables_and_units(spark, obs, tmp_path):
    root = str(tmp_path)
    assert write_table(None, root, "breaks") is None
    write_table(obs, root, "signal_vector", {"value": "mm"})
    write_sidecar(obs.where("false"), root, "velocity_field", "components")
    assert units_of(read_table(spark, root, "signal_vector")) == {"value": "mm"} and read_table(spark, root, "velocity_field_components").count() == 0
    assert read_table(spark, root, "nothing") is None


def test_validation(spark, obs):
    assert validate_observations(obs).ok and not validate_observations(obs.drop("value")).ok
    bad = spark.createDataFrame([("c", None, 0.0, float("inf")), ("c", "s", 1.0, None)], OBS)
    report = validate_observations(bad)
    assert not report.ok and len(report.warnings) == 2 and "invalid" in report.summary()
    assert finite_or_null(bad).where("value is not null").count() == 0
    assert drop_dead_columns(obs.withColumn("flat", F.lit(1.0)), ["cohort", "signal_id"]).columns == ["cohort", "signal_id", "signal_0", "value"]
    assert not validate_manifest({}).ok


def test_manifest_and_config(tmp_path):
    m = parse_manifest({"paths": {"observations": "o.parquet", "output_dir": "/out"}, "system": {"window": 50, "stride": 10}, "cohorts": {"a": {"s": {"engine_window_overrides": {"memory": 99}}}}, "engine_gates": {"memory": {"metric": "cv", "gt": 1}}, "segments": [{"name": "x", "range": [0, None]}], "intervention": {"enabled": True, "event_index": 7}}, "/base")
    assert m.observations == "/base/o.parquet" and m.output == "/out" and m.overrides() == [("a", "s", "memory", 99)] and m.gates[0].gt == 1 and m.segments == (("x", 0.0, None),) and m.intervention == 7
    with pytest.raises(ValueError):
        parse_manifest({"system": {"mode": "sometimes"}})
    (tmp_path / "domains").mkdir()
    (tmp_path / "domains" / "d.yaml").write_text("dynamics:\n  smoothing: 5\n")
    c = Config(str(tmp_path), "d")
    assert c.get("dynamics.smoothing") == 5 and c.get("dynamics.collapse.min_collapse_length") == 3 and c.get("no.such", 1) == 1
    assert deep_merge({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_query_runs(spark, sf_dir, name):
    """The others are compared with their SQL in test_sql.py."""
    made = Q.QUERIES[name](spark, sf_dir)
    assert made.columns and len(set(made.columns)) == len(made.columns)
    made.limit(3).collect()


def test_flagship(spark, sf_dir):
    assert Q.flagship(spark, sf_dir).count() > 0


@pytest.mark.parametrize("axis", [False, True])
def test_interpolation_reads_rows_once(spark, axis):
    """The next value is found without frames that reach to the end from every row."""
    rng = np.random.default_rng(3)
    s, y = np.cumsum(rng.integers(1, 5, 3000)).astype(float), rng.normal(size=3000)
    y[rng.random(3000) < 0.4] = np.nan
    y[:3] = y[-4:] = np.nan
    obs = spark.createDataFrame([("a", "x", float(a), float(b)) for a, b in zip(s, y, strict=True)] + [("a", "none", 1.0, None)], "cohort string, signal_id string, signal_0 double, value double")
    made = interpolate(obs, axis)
    assert "unboundedfollowing" not in made._jdf.queryExecution().executedPlan().toString().lower()
    assert made.columns == obs.columns and made.where("signal_id = 'none'").first()["value"] is None
    got = made.where("signal_id = 'x'").orderBy("signal_0").toPandas()["value"].to_numpy()
    at, known = s if axis else np.arange(3000.0), np.isfinite(y)
    assert np.allclose(got, np.interp(at, at[known], y[known]))


def _value_on_mean(seed, n):
    """Cents whose mean is the first of them, and the changes of their signs about it."""
    c = np.random.default_rng(seed).integers(100, 9000, n - 1)
    c = np.append(c, n * c[0] - c.sum())
    side = np.sign(c - c[0])
    return c / 100, int((side[1:] != side[:-1]).sum())


def test_crossings_with_a_value_on_the_mean(spark, tmp_path):
    """A sum's rounding puts no value beside a mean that it equals."""
    y, want = _value_on_mean(92, 32)
    assert Q.QUERIES["window_arrays"](spark, _events(spark, tmp_path, {"a": y})).first()["mean_crossings"] == want


def test_crossing_rate_with_a_value_on_the_mean():
    y, want = _value_on_mean(129, 64)
    assert abs(metrics(y)["zero_crossing_rate"] - want / 63) < 1e-12
