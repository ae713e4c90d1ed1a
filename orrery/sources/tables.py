"""Named output tables: where they lie, how they are written, what units they carry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# fixed values: the places of output tables
TABLES = {
    "typology_windows": "signal", "typology_vector": "signal", "signal_vector": "signal", "signal_geometry": "signal", "signal_stability": "signal",
    "cohort_vector": "cohort", "cohort_geometry": "cohort", "cohort_signal_positions": "cohort", "cohort_feature_loadings": "cohort", "cohort_pairwise": "cohort", "cohort_information_flow": "cohort",
    "breaks": "cohort/cohort_dynamics", "geometry_dynamics": "cohort/cohort_dynamics", "ftle": "cohort/cohort_dynamics", "ftle_backward": "cohort/cohort_dynamics", "lyapunov": "cohort/cohort_dynamics",
    "thermodynamics": "cohort/cohort_dynamics", "ftle_field": "cohort/cohort_dynamics", "velocity_field": "cohort/cohort_dynamics", "velocity_field_components": "cohort/cohort_dynamics",
    "ftle_rolling": "cohort/cohort_dynamics", "ridge_proximity": "cohort/cohort_dynamics", "persistent_homology": "cohort/cohort_dynamics",
    "signal_dominance": "parameterization",
    "system_vector": "system", "system_geometry": "system", "system_cohort_positions": "system", "system_pairwise": "system", "system_information_flow": "system",
    "trajectory_signatures": "system", "trajectory_library": "system", "trajectory_match": "system",
    "system_ftle": "system/system_dynamics", "system_velocity_field": "system/system_dynamics",
}


def table_path(root: str, name: str) -> str:
    folder = TABLES.get(name)
    return f"{root.rstrip('/')}/{folder}/{name}.parquet" if folder else f"{root.rstrip('/')}/{name}.parquet"


def write_table(df: DataFrame | None, root: str, name: str, units: dict[str, str] | None = None, partition_by: str | None = None) -> str | None:
    """Write a named table.  None and tables without columns are skipped, tables without
    rows keep their schema.  ``units`` go into the columns' metadata."""
    if df is None or not df.columns:
        return None
    path = table_path(root, name)
    writer = (with_units(df, units) if units else df).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def write_sidecar(df: DataFrame | None, root: str, parent: str, suffix: str) -> str | None:
    return write_table(df, root, f"{parent}_{suffix}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A named table, from its place or from the root; None if there is none."""
    for path in dict.fromkeys((table_path(root, name), f"{root.rstrip('/')}/{name}.parquet")):
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    return None


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Units as column metadata, which parquet keeps."""
    return df.select(*[F.col(c).alias(c, metadata={"unit": units[c]}) if c in units else F.col(c) for c in df.columns])


def units_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["unit"] for f in df.schema.fields if "unit" in f.metadata}


def units_json(df: DataFrame) -> str:
    return json.dumps(units_of(df), sort_keys=True)


def velocity_units(axis: str = "signal_0") -> dict[str, str]:
    return {"signal_0": axis, "speed": f"sd/{axis}", "acceleration_magnitude": f"sd/{axis}^2", "acceleration_parallel": f"sd/{axis}^2", "acceleration_perpendicular": f"sd/{axis}^2", "curvature": "1/sd", "motion_dimensionality": "dimensions"}


def dynamics_units(axis: str = "signal_0") -> dict[str, str]:
    return {"signal_0_end": axis, "effective_dim": "dimensions", "effective_dim_velocity": f"dimensions/{axis}", "effective_dim_acceleration": f"dimensions/{axis}^2", "effective_dim_jerk": f"dimensions/{axis}^3"}


def geometry_units(axis: str = "signal_0") -> dict[str, str]:
    return {"signal_0_end": axis, "effective_dim": "dimensions", "total_variance": "variance", "eigenvalue_entropy": "bits", "condition_number": "ratio"}
