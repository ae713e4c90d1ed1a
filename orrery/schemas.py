"""Declared schemas: every table has one, whatever its rows."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATIONS = T.StructType([
    T.StructField("cohort", T.StringType()),
    T.StructField("signal_id", T.StringType()),
    T.StructField("signal_0", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])
DEFAULT_COHORT = "_default"

#: Subspaces of the feature vector, by name.
FEATURE_GROUPS = {
    "shape": ["kurtosis", "skewness", "crest_factor"],
    "complexity": ["permutation_entropy", "hurst", "acf_lag1"],
    "spectral": ["spectral_entropy", "spectral_centroid", "band_low_rel", "band_mid_rel", "band_high_rel"],
}


def available_groups(columns: list[str], groups: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Groups with at least two of their features among the columns; without any, the
    first three columns as ``full``."""
    found = {name: [f for f in own if f in columns] for name, own in (groups or FEATURE_GROUPS).items()}
    found = {name: own for name, own in found.items() if len(own) >= 2}
    return found or ({"full": columns[:3]} if columns else {})
