"""Checks of inputs and prerequisites before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


class InputError(ValueError):
    pass


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    n_rows: int = 0
    n_signals: int = 0
    n_cohorts: int = 0
    constant_signals: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    def summary(self) -> str:
        state = "valid" if self.ok else "invalid"
        return "\n".join([f"{state}: {self.n_rows} rows, {self.n_signals} signals, {self.n_cohorts} cohorts", *[f"error: {e}" for e in self.errors], *[f"warning: {w}" for w in self.warnings]])

    def to_dict(self) -> dict:
        return {"ok": self.ok, **self.__dict__}


def validate_observations(obs: DataFrame) -> Report:
    """Required columns, nulls and infinities, in one aggregation."""
    report = Report()
    missing = [c for c in ("signal_id", "signal_0", "value") if c not in obs.columns]
    if missing:
        report.errors.append(f"observations lack {', '.join(missing)}")
        return report
    cohort = F.col("cohort") if "cohort" in obs.columns else F.lit("_default")
    value = F.col("value").cast("double")
    row = obs.agg(
        F.count("*").alias("n"), F.count_distinct("signal_id").alias("signals"), F.count_distinct(cohort).alias("cohorts"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("signal_id", "signal_0", "value")],
        F.count_if(F.abs(value) == float("inf")).alias("inf"), F.count_if(F.isnan(value)).alias("nan"),
    ).first()
    report.n_rows, report.n_signals, report.n_cohorts = row["n"], row["signals"], row["cohorts"]
    if not row["n"]:
        report.errors.append("observations have no rows")
    for c in ("signal_id", "signal_0"):
        if row[f"null_{c}"]:
            report.errors.append(f"{row[f'null_{c}']} rows have no {c}")
    for what, n in (("no value", row["null_value"]), ("an infinite value", row["inf"]), ("NaN as value", row["nan"])):
        if n:
            report.warnings.append(f"{n} rows have {what}")
    return report


def validate_typology(typology: DataFrame) -> Report:
    report = Report()
    if "signal_id" not in typology.columns:
        report.errors.append("typology lacks signal_id")
    if not {"is_constant", "signal_std", "temporal_primary", "temporal_pattern"} & set(typology.columns):
        report.warnings.append("typology says nothing about constancy")
    return report


def validate_manifest(manifest: dict) -> Report:
    report = Report()
    for key in ("paths", "system"):
        if key not in manifest:
            report.errors.append(f"manifest lacks {key}")
    if "cohorts" not in manifest:
        report.warnings.append("manifest names no cohorts: all signals are taken")
    return report


def _is_constant(typology: DataFrame) -> Column:
    found = F.lit(False)
    pattern = next((c for c in ("temporal_primary", "temporal_pattern") if c in typology.columns), None)
    for c in (pattern, "continuity"):
        if c in typology.columns:
            found = found | (F.upper(F.col(c)) == "CONSTANT")
    if "is_constant" in typology.columns:
        found = found | F.col("is_constant").cast("boolean")
    elif "signal_std" in typology.columns:
        found = found | (F.col("signal_std") <= 1e-10)
    return F.coalesce(found, F.lit(False))


def drop_constant_signals(obs: DataFrame, typology: DataFrame) -> DataFrame:
    """Without the signals that the typology calls constant (an anti join before any
    window is made)."""
    keys = [c for c in ("cohort", "signal_id") if c in typology.columns and c in obs.columns]
    return obs.join(typology.where(_is_constant(typology)).select(*keys).distinct(), keys, "left_anti")


def active_signals(obs: DataFrame, typology: DataFrame) -> DataFrame:
    keys = [c for c in ("cohort", "signal_id") if c in typology.columns and c in obs.columns]
    return obs.join(typology.where(~_is_constant(typology)).select(*keys).distinct(), keys, "left_semi")


def finite_or_null(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Infinities and NaN become null in all floating columns but those kept."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(bad(c), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") and c not in keep else F.col(c) for c in df.columns])


def drop_dead_columns(df: DataFrame, keys: list[str], most_dead: float = 0.9) -> DataFrame:
    """Without the columns that are null or NaN in more than ``most_dead`` of the rows, or
    constant; one aggregation decides."""
    own = [(c, k) for c, k in df.dtypes if c not in keys and k in ("double", "float")]
    if not own:
        return df
    row = df.agg(F.count("*").alias("n"), *[x for i, (c, _) in enumerate(own) for x in (F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"d{i}"), F.min(F.nanvl(F.col(c), F.lit(None))).alias(f"a{i}"), F.max(F.nanvl(F.col(c), F.lit(None))).alias(f"b{i}"))]).first()
    dead = [c for i, (c, _) in enumerate(own) if row["n"] and (row[f"d{i}"] > most_dead * row["n"] or row[f"a{i}"] == row[f"b{i}"])]
    return df.drop(*dead)


#: Which tables must be there before a stage can run.
PREREQUISITES = {"signal_vector": ["typology_vector"], "cohort_vector": ["signal_vector"], "cohort_geometry": ["signal_vector", "cohort_vector"], "cohort_pairwise": ["signal_vector", "cohort_vector", "cohort_signal_positions"]}


def check_prerequisites(spark: SparkSession, root: str, stage: str) -> list[str]:
    """The tables that a stage still misses."""
    return [t for t in PREREQUISITES.get(stage, []) if read_table(spark, root, t) is None]


def pipeline_status(spark: SparkSession, root: str) -> dict[str, bool]:
    return {stage: not check_prerequisites(spark, root, stage) for stage in PREREQUISITES}


def next_stage(spark: SparkSession, root: str) -> str | None:
    """The first stage that can run and has not."""
    return next((s for s, ready in pipeline_status(spark, root).items() if ready and read_table(spark, root, s) is None), None)
