"""Normalisers with parameters that can be kept and undone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNAL = ["cohort", "signal_id"]
METHODS = ("zscore", "robust", "mad", "minmax", "none")


def parameters(obs: DataFrame, method: str = "zscore", keys: list[str] = SIGNAL) -> DataFrame:
    """(keys, centre, scale): a scale that would be 0 is 1."""
    v = F.col("value")
    median = F.percentile(v, 0.5)
    if method == "mad":
        rows = obs.join(obs.groupBy(*keys).agg(median.alias("centre")), keys)
        made = rows.groupBy(*keys).agg(F.first("centre").alias("centre"), (1.4826 * F.percentile(F.abs(v - F.col("centre")), 0.5)).alias("scale"))
    elif method in METHODS:
        centre, scale = {"zscore": (F.avg(v), F.stddev_pop(v)), "robust": (median, F.percentile(v, 0.75) - F.percentile(v, 0.25)), "minmax": (F.min(v), F.max(v) - F.min(v)), "none": (F.min(F.lit(0.0)), F.min(F.lit(1.0)))}[method]
        made = obs.groupBy(*keys).agg(centre.alias("centre"), scale.alias("scale"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return made.withColumn("scale", F.when(F.col("scale") > 1e-10, F.col("scale")).otherwise(1.0))


def normalise(obs: DataFrame, params: DataFrame, keys: list[str] = SIGNAL) -> DataFrame:
    return obs.join(params, keys).withColumn("value", (F.col("value") - F.col("centre")) / F.col("scale")).drop("centre", "scale")


def denormalise(obs: DataFrame, params: DataFrame, keys: list[str] = SIGNAL) -> DataFrame:
    return obs.join(params, keys).withColumn("value", F.col("value") * F.col("scale") + F.col("centre")).drop("centre", "scale")


def recommend(obs: DataFrame, keys: list[str] = SIGNAL) -> DataFrame:
    """(keys, method): by the share of outliers and the shape of the distribution."""
    v = F.col("value")
    ends = obs.groupBy(*keys).agg(F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    out = (v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr)
    varies = (F.stddev_pop(v) > 1e-12) & (F.count(v) >= 4)
    made = obs.join(ends, keys).groupBy(*keys).agg((F.count_if(out) / F.count("*")).alias("outlier_fraction"), F.when(varies, F.kurtosis(v)).alias("kurtosis"), F.when(varies, F.skewness(v)).alias("skewness"))
    k, s = F.coalesce(F.col("kurtosis"), F.lit(0.0)), F.abs(F.coalesce(F.col("skewness"), F.lit(0.0)))
    return made.withColumn("method", F.when(F.col("outlier_fraction") > 0.05, "mad").when(k > 10, "mad").when(k > 3, "robust").when(s > 1, "robust").otherwise("zscore"))
