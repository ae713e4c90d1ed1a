"""Discrete-state features of windows: levels, transitions, dwell times.

Everything is an expression over the window's array, evaluated without a shuffle after
the one that made the windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .windows import SIGNAL, arrays, spread

KEYS = [*SIGNAL, "window_id", "signal_0_end"]


def discrete_features(obs: DataFrame, window: int, stride: int, bins: int = 10) -> DataFrame:
    """Entropies, occupancy, duty, transitions and runs of every window."""
    rows = spread(arrays(obs, window, stride).select(*KEYS, "y")).withColumn("level", C.level_labels(F.col("y"), bins))
    rows = rows.withColumn("names", F.array_sort(F.array_distinct("level"))).withColumn("shares", F.transform("names", lambda v: F.size(F.filter("level", lambda x: x == v)).cast("double") / F.size("level")))
    rows = rows.withColumn("steps", F.transform(C.pairs(F.col("level"), 1), lambda p: p["a"] * 1000 + p["b"])).withColumn("ordered", F.sort_array("shares", asc=False)).withColumn("run", F.transform(C.runs(F.col("y")), lambda r: r["n"].cast("double")))
    k, n = F.size("names"), F.size("y")
    joint, lone = C.entropy_of(F.col("steps")), C.entropy_of(F.transform(C.pairs(F.col("level"), 1), lambda p: p["a"]))
    shannon = F.aggregate("shares", F.lit(0.0), lambda a, p: a - p * F.log2(p))
    conditional = F.greatest(joint - lone, F.lit(0.0))
    stay = F.size(F.filter(C.pairs(F.col("level"), 1), lambda p: p["a"] == p["b"]))
    dwell = C.moments(F.col("run"))
    return rows.select(
        *KEYS,
        shannon.alias("shannon_entropy"),
        F.when(k > 1, shannon / F.log2(F.least(k, F.lit(bins)).cast("double"))).otherwise(0.0).alias("normalized_entropy"),
        conditional.alias("conditional_entropy"), (shannon - conditional).alias("excess_entropy"),
        k.alias("n_levels"), (k.cast("double") / n).alias("level_occupancy"),
        F.col("ordered")[0].alias("duty_dominant"), F.coalesce(F.get("ordered", F.lit(1)), F.lit(0.0)).alias("duty_secondary"), (F.array_max("shares") - F.array_min("shares")).alias("duty_range"),
        (n - 1 - stay).alias("transition_count"), F.try_divide(stay.cast("double"), (n - 1).cast("double")).alias("trans_self_loop"), F.size(F.array_distinct("steps")).alias("trans_n_active"),
        F.when(k > 1, 1 - F.size(F.array_distinct("steps")) / (k * k).cast("double")).otherwise(1.0).alias("trans_sparsity"),
        F.size("run").alias("n_dwells"), *[v.alias(f"dwell_{name}") for name, v in dwell.items()],
    )
