"""Relational summaries of the observation table: statistics, z-scores, robust
departures, correlations, Gaussian fingerprints and their similarity.

Per-signal statistics that go back to the rows are window aggregates over
(cohort, signal_id), so that each needs one exchange and no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNAL = ["cohort", "signal_id"]
EPS = 1e-10

#: Features of a Gaussian fingerprint, and the pairs whose correlation it holds.
FINGERPRINT_FEATURES = ["spectral_entropy", "hurst", "sample_entropy", "dfa", "acf_decay", "kurtosis", "skewness", "trend_r2", "recurrence_rate", "determinism"]
FINGERPRINT_PAIRS = {"corr_entropy_hurst": ("spectral_entropy", "hurst"), "corr_spectral_sample_entropy": ("spectral_entropy", "sample_entropy"), "corr_hurst_dfa": ("hurst", "dfa"), "corr_kurtosis_skewness": ("kurtosis", "skewness")}


def quantile(column: str | Column, p: float, exact: bool = True) -> Column:
    """Exact quantiles hold a group's distinct values in the aggregation's buffer; for signals
    too long for that the sketch bounds it (relative rank error 1e-4)."""
    return F.percentile(column, p) if exact else F.percentile_approx(column, p, 10_000)


def statistics(obs: DataFrame, exact: bool = True) -> DataFrame:
    v = F.col("value")
    q1, q3 = quantile(v, 0.25, exact), quantile(v, 0.75, exact)
    return obs.groupBy(*SIGNAL).agg(
        F.count("*").alias("n_points"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"), quantile(v, 0.5, exact).alias("median"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        F.var_samp(v).alias("variance"), F.try_divide(F.stddev_samp(v), F.nullif(F.abs(F.avg(v)), F.lit(0.0))).alias("cv"),
    )


def zscore(obs: DataFrame, threshold: float = 3.0) -> DataFrame:
    own = Window.partitionBy(*SIGNAL)
    rows = obs.withColumns({"__m": F.avg("value").over(own), "__s": F.stddev_samp("value").over(own)})
    z = F.when(F.col("__s") > EPS, (F.col("value") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return rows.select(*SIGNAL, "signal_0", "value", z.alias("z_score"), F.coalesce((F.col("__s") > EPS) & (F.abs(z) > threshold), F.lit(False)).alias("is_departure"))


def _severity(score: Column, mad: Column) -> Column:
    """Bands of the absolute robust score."""
    a = F.abs(score)
    return F.when(mad <= EPS, "CONSTANT").when(a > 5.0, "CRITICAL").when(a > 3.5, "SEVERE").when(a > 2.5, "MODERATE").when(a > 2.0, "MILD").otherwise("NORMAL")


def mad_departure(obs: DataFrame, threshold: float = 3.5, exact: bool = True) -> DataFrame:
    """Scores 0.6745 (x - median) / MAD.  Exact medians are aggregations; the two small
    tables of them join back on the signal."""
    median = obs.groupBy(*SIGNAL).agg(quantile("value", 0.5, exact).alias("median_value"))
    rows = obs.join(median, SIGNAL)
    mad = rows.groupBy(*SIGNAL).agg(quantile(F.abs(F.col("value") - F.col("median_value")), 0.5, exact).alias("mad_value"))
    score = F.when(F.col("mad_value") > EPS, 0.6745 * (F.col("value") - F.col("median_value")) / F.col("mad_value")).otherwise(0.0)
    out = rows.join(mad, SIGNAL).withColumn("mad_score", score)
    flag = F.coalesce((F.col("mad_value") > EPS) & (F.abs("mad_score") > threshold), F.lit(False))
    return out.select(*SIGNAL, "signal_0", "value", "median_value", "mad_value", "mad_score", flag.alias("is_departure"), _severity(F.col("mad_score"), F.col("mad_value")).alias("severity"))


def rolling_mad_departure(obs: DataFrame, half: int = 50, threshold: float = 3.5) -> DataFrame:
    """The same against medians of 2 ``half`` + 1 rows around each row."""
    around = Window.partitionBy(*SIGNAL).orderBy("signal_0").rowsBetween(-half, half)
    rows = obs.withColumn("rolling_median", F.percentile("value", 0.5).over(around)).withColumn("__d", F.abs(F.col("value") - F.col("rolling_median")))
    rows = rows.withColumn("rolling_mad", F.percentile("__d", 0.5).over(around))
    score = F.when(F.col("rolling_mad") > EPS, 0.6745 * (F.col("value") - F.col("rolling_median")) / F.col("rolling_mad")).otherwise(0.0)
    return rows.select(*SIGNAL, "signal_0", "value", "rolling_median", "rolling_mad", score.alias("mad_score"), F.coalesce((F.col("rolling_mad") > EPS) & (F.abs(score) > threshold), F.lit(False)).alias("is_departure"))


def correlation(obs: DataFrame, least: int = 10) -> DataFrame:
    """Pearson correlation of all pairs of signals of a cohort at equal signal_0: an equi
    join on (cohort, signal_0) with the pair's order as residual condition."""
    a = obs.select("cohort", "signal_0", F.col("signal_id").alias("signal_a"), F.col("value").alias("x"))
    b = obs.select("cohort", "signal_0", F.col("signal_id").alias("signal_b"), F.col("value").alias("y"))
    pairs = a.join(b, ["cohort", "signal_0"]).where("signal_a < signal_b")
    return pairs.groupBy("cohort", "signal_a", "signal_b").agg(safe_corr("x", "y").alias("correlation"), F.count("*").alias("n_points")).where(F.col("n_points") >= least)


def safe_corr(x: str, y: str) -> Column:
    """Correlation of the rows that have both; null where either does not vary (ANSI mode
    would fail)."""
    sx = F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    sy = F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y)))
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop(x, y), sx * sy))


def gaussian_fingerprint(vector: DataFrame, features: list[str] = FINGERPRINT_FEATURES) -> DataFrame:
    """Mean and spread of each feature over a signal's windows, four correlations, and
    the mean spread.  Features that the table lacks are null."""
    have = set(vector.columns)
    f = {c: (F.col(c).cast("double") if c in have else F.lit(None).cast("double")) for c in features}
    rows = vector.select(*SIGNAL, *[f[c].alias(c) for c in features])
    means = [F.avg(c).alias(f"mean_{c}") for c in features]
    stds = [F.stddev_samp(c).alias(f"std_{c}") for c in features]
    corrs = [safe_corr(a, b).alias(name) for name, (a, b) in FINGERPRINT_PAIRS.items() if a in features and b in features]
    made = rows.groupBy(*SIGNAL).agg(F.count("*").alias("n_windows"), *means, *stds, *corrs)
    spread = sum((F.coalesce(F.col(f"std_{c}"), F.lit(0.0)) for c in features), F.lit(0.0)) / len(features)
    return made.withColumn("fingerprint_volatility", spread)


def gaussian_similarity(prints: DataFrame, features: list[str] = FINGERPRINT_FEATURES) -> DataFrame:
    """Bhattacharyya distances of all pairs of a cohort's signals, feature by feature,
    their sum, and exp(-sum)."""
    a = prints.select("cohort", *[F.col(c).alias(f"a_{c}") for c in prints.columns if c != "cohort"])
    b = prints.select("cohort", *[F.col(c).alias(f"b_{c}") for c in prints.columns if c != "cohort"])
    pairs = a.join(b, "cohort").where("a_signal_id < b_signal_id")

    def distance(c: str) -> Column:
        ma, mb, sa, sb = (F.col(f"{side}_{kind}_{c}") for kind in ("mean", "std") for side in ("a", "b"))
        v = sa * sa + sb * sb
        return F.when((sa > EPS) & (sb > EPS), 0.25 * F.pow(ma - mb, F.lit(2.0)) / v + 0.5 * F.log(v / (2.0 * sa * sb)))

    made = pairs.select("cohort", F.col("a_signal_id").alias("signal_a"), F.col("b_signal_id").alias("signal_b"), *[distance(c).alias(f"db_{c}") for c in features], F.abs(F.col("a_fingerprint_volatility") - F.col("b_fingerprint_volatility")).alias("volatility_diff"))
    total = sum((F.coalesce(F.col(f"db_{c}"), F.lit(0.0)) for c in features), F.lit(0.0))
    count = sum((F.col(f"db_{c}").isNotNull().cast("int") for c in features), F.lit(0))
    made = made.withColumns({"bhattacharyya_distance": total, "n_features": count})
    return made.withColumns({"normalized_distance": F.try_divide(F.col("bhattacharyya_distance"), F.nullif(F.col("n_features"), F.lit(0)).cast("double")), "similarity": F.exp(-F.col("bhattacharyya_distance"))})
