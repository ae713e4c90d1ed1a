"""Structural breaks of signals.

CUSUM carries its state from row to row, so a signal is one task's stream: rows are
sorted within their partition and folded signal by signal.  A signal longer than
``block`` rows is folded in blocks that overlap by the context a break needs, which
bounds a task's memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.break_kernel import find_breaks
from .windows import SIGNAL

SCHEMA = "cohort string, signal_id string, signal_0 double, `index` long, magnitude double, direction byte, sharpness double, duration int, pre_level double, post_level double, snr double"


def breaks(obs: DataFrame, sensitivity: float = 1.0, context: int = 50, block: int = 200_000) -> DataFrame:
    """A row for each break; ``index`` counts the signal's rows in order of signal_0."""
    margin = 10 * context
    rows = obs.withColumn("i", F.row_number().over(Window.partitionBy(*SIGNAL).orderBy("signal_0", "value")) - 1)
    own = F.floor(F.col("i") / block)
    spread = F.array_distinct(F.array(own, F.greatest(F.floor((F.col("i") - margin) / block), F.lit(0)), F.floor((F.col("i") + margin) / block)))
    rows = rows.withColumn("block", F.explode(spread))

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i", kind="stable")
        first, number = int(b["i"].iloc[0]), int(key[2])
        found = [f | {"index": f["index"] + first} for f in find_breaks(b["value"].to_numpy(float), sensitivity, context)]
        found = [f for f in found if f["index"] // block == number]
        s = b["signal_0"].to_numpy(float)
        made = pd.DataFrame(found, columns=["index", "magnitude", "direction", "sharpness", "duration", "pre_level", "post_level", "snr"])
        at = made["index"].to_numpy(np.int64) - first
        made.insert(0, "signal_0", s[at] if len(at) else np.zeros(0))
        made.insert(0, "signal_id", key[1])
        made.insert(0, "cohort", key[0])
        return made.astype({"index": "int64", "direction": "int8", "duration": "int32"})

    return rows.groupBy(*SIGNAL, "block").applyInPandas(run, SCHEMA)


def break_summary(found: DataFrame) -> DataFrame:
    spacing = F.col("index") - F.lag("index").over(Window.partitionBy(*SIGNAL).orderBy("index"))
    size = F.abs("magnitude")
    return found.withColumn("spacing", spacing.cast("double")).groupBy(*SIGNAL).agg(F.count("*").alias("n_breaks"), F.avg("spacing").alias("mean_spacing"), F.avg(size).alias("mean_magnitude"), F.max(size).alias("max_magnitude"), F.avg("sharpness").alias("mean_sharpness"), F.max("sharpness").alias("max_sharpness"))
