"""The stage graph: what each table is made of, and a runner.

Stages are lazy functions of tables.  A run writes the tables asked for, in order of
their inputs; tables that several others read are read back from where they were written,
so that nothing is computed twice and a lost executor costs no more than its tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import breaks as B
from ..operators import dynamics as D
from ..operators import fleet as L
from ..operators import geometry as G
from ..operators import pairwise as P
from ..operators import segments as SG
from ..operators import state as S
from ..operators import typology as T
from ..operators.signal_vector import signal_vector
from ..schemas import available_groups
from ..sources.manifest import Manifest
from ..sources.observations import pivot, read_observations, signal_ids
from ..sources.tables import dynamics_units, geometry_units, read_table, velocity_units, write_table
from ..sources.validation import InputError, drop_constant_signals, validate_observations

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[str, ...]
    make: Callable[[Tables, Manifest], DataFrame]
    fleet: bool = False
    units: Callable[[str], dict[str, str]] | None = None


def _features(t: Tables) -> list[str]:
    return S.usable_features(t["signal_vector"])


def _system_features(wide: DataFrame) -> list[str]:
    own = [c for c in ("shape_effective_dim", "complexity_effective_dim", "spectral_effective_dim") if c in wide.columns]
    return own


def _pairs(t: Tables, m: Manifest) -> DataFrame:
    from functools import reduce

    groups = available_groups(t["signal_vector"].columns)
    return reduce(DataFrame.unionByName, [P.feature_pairs(t["signal_vector"], e, f, t["cohort_signal_positions"]) for e, f in groups.items()])


def _signal_geometry(t: Tables, m: Manifest) -> DataFrame:
    from functools import reduce

    groups = available_groups(t["signal_vector"].columns)
    return reduce(DataFrame.unionByName, [G.signal_geometry(t["signal_vector"], t["cohort_feature_loadings"], t["cohort_vector"], e, f) for e, f in groups.items()])


def _wide(t: Tables) -> tuple[DataFrame, list[str]]:
    signals = signal_ids(t["observations"])
    return pivot(t["observations"], signals), signals


def _segments(t: Tables, m: Manifest) -> list[SG.Segment]:
    return list(m.segments) or SG.default_segments(t["observations"])


STAGES = [
    Stage("breaks", ("observations",), lambda t, m: B.breaks(t["observations"])),
    Stage("typology_windows", ("observations",), lambda t, m: T.typology_windows(t["observations"], m.window, m.stride)),
    Stage("typology_vector", ("typology_windows",), lambda t, m: T.summarise(t["typology_windows"])),
    Stage("signal_vector", ("observations", "typology_windows"), lambda t, m: signal_vector(t["observations"], m.window, m.stride, None, m, t["typology_windows"])),
    Stage("cohort_vector", ("signal_vector",), lambda t, m: S.cohort_vector(t["signal_vector"])),
    Stage("cohort_geometry", ("signal_vector",), lambda t, m: G.cohort_geometry(t["signal_vector"])["geometry"], units=geometry_units),
    Stage("cohort_signal_positions", ("signal_vector",), lambda t, m: G.cohort_geometry(t["signal_vector"], None, False)["positions"]),
    Stage("cohort_feature_loadings", ("signal_vector",), lambda t, m: G.cohort_geometry(t["signal_vector"], None, False)["loadings"]),
    Stage("signal_dominance", ("cohort_signal_positions",), lambda t, m: G.signal_dominance(t["cohort_signal_positions"])),
    Stage("signal_geometry", ("signal_vector", "cohort_vector", "cohort_feature_loadings"), _signal_geometry),
    Stage("cohort_pairwise", ("signal_vector", "cohort_signal_positions"), _pairs),
    Stage("geometry_dynamics", ("cohort_geometry",), lambda t, m: D.geometry_dynamics(t["cohort_geometry"]), units=dynamics_units),
    Stage("ftle", ("observations",), lambda t, m: D.ftle(t["observations"], "forward", m.intervention)),
    Stage("ftle_backward", ("observations",), lambda t, m: D.ftle(t["observations"], "backward", m.intervention)),
    Stage("lyapunov", ("observations",), lambda t, m: D.lyapunov(t["observations"])),
    Stage("thermodynamics", ("cohort_geometry",), lambda t, m: D.thermodynamics(t["cohort_geometry"])),
    Stage("cohort_information_flow", ("observations", "cohort_pairwise"), lambda t, m: P.information_flow(t["observations"], t["cohort_pairwise"].where("needs_granger"))),
    Stage("velocity_field_components", ("observations",), lambda t, m: D.velocity_components(t["observations"], True, True)),
    Stage("velocity_field", ("velocity_field_components",), lambda t, m: D.velocity_field(t["velocity_field_components"]), units=velocity_units),
    Stage("ftle_rolling", ("observations",), lambda t, m: D.ftle_rolling(t["observations"])),
    Stage("ridge_proximity", ("ftle_rolling", "velocity_field"), lambda t, m: D.ridge_proximity(t["ftle_rolling"], t["velocity_field"])),
    Stage("ftle_field", ("cohort_geometry",), lambda t, m: L.ftle_field(t["cohort_geometry"])),
    Stage("lyapunov_rolling", ("observations",), lambda t, m: D.lyapunov_rolling(t["observations"])),
    Stage("segment_comparison", ("observations",), lambda t, m: SG.segment_comparison(*_wide(t), _segments(t, m))),
    Stage("info_flow_delta", ("observations", "cohort_pairwise"), lambda t, m: SG.info_flow_delta(t["observations"], _segments(t, m), flagged=t["cohort_pairwise"].where("needs_granger"))),
    Stage("sensor_eigendecomp", ("observations",), lambda t, m: SG.sensor_eigendecomp(*_wide(t))),
    Stage("cohort_baseline", ("observations",), lambda t, m: SG.cohort_baseline(*_wide(t))),
    Stage("observation_geometry", ("observations", "cohort_baseline"), lambda t, m: SG.observation_geometry(_wide(t)[0], t["cohort_baseline"], _wide(t)[1])),
    Stage("signal_stability", ("observations",), lambda t, m: D.signal_stability(t["observations"])),
    Stage("persistent_homology", ("cohort_vector",), lambda t, m: D.persistent_homology(t["cohort_vector"])),
    Stage("system_wide", ("cohort_geometry",), lambda t, m: L.pivot_geometry(t["cohort_geometry"]), True),
    Stage("system_vector", ("system_wide",), lambda t, m: L.system_vector(t["system_wide"]), True),
    Stage("system_geometry", ("system_wide",), lambda t, m: L.system_geometry(t["system_wide"], _system_features(t["system_wide"]))["geometry"], True),
    Stage("system_cohort_positions", ("system_wide",), lambda t, m: L.system_geometry(t["system_wide"], _system_features(t["system_wide"]))["positions"], True),
    Stage("system_pairwise", ("system_wide", "system_cohort_positions"), lambda t, m: L.system_pairwise(t["system_wide"], _system_features(t["system_wide"]), t["system_cohort_positions"]), True),
    Stage("system_information_flow", ("system_wide", "system_pairwise"), lambda t, m: L.system_information_flow(t["system_wide"], flagged=t["system_pairwise"]), True),
    Stage("system_ftle", ("system_wide",), lambda t, m: L.system_ftle(t["system_wide"]), True),
    Stage("system_velocity_field", ("system_wide",), lambda t, m: L.system_velocity_field(t["system_wide"], _system_features(t["system_wide"])), True),
    Stage("trajectory_signatures", ("cohort_geometry", "geometry_dynamics", "velocity_field"), lambda t, m: L.trajectory_signatures(t["cohort_geometry"], t["geometry_dynamics"], t["velocity_field"]), True),
    Stage("trajectory_library", ("trajectory_signatures",), lambda t, m: L.trajectory_library(t["trajectory_signatures"])["library"], True),
    Stage("trajectory_match", ("trajectory_signatures",), lambda t, m: L.trajectory_library(t["trajectory_signatures"])["match"], True),
]
BY_NAME = {s.name: s for s in STAGES}


def plan(only: list[str] | None = None, skip: tuple[str, ...] = (), fleet: bool = True) -> list[Stage]:
    """The stages asked for and what they need, in order."""
    unknown = sorted(set(only or ()) - BY_NAME.keys())
    if unknown:
        raise ValueError(f"no such stages: {', '.join(unknown)}")
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name in BY_NAME and name not in wanted:
            wanted.add(name)
            for i in BY_NAME[name].inputs:
                want(i)

    for s in STAGES:
        if (only is None or s.name in only) and s.name not in skip and (fleet or not s.fleet):
            want(s.name)
    return [s for s in STAGES if s.name in wanted]


def run(spark: SparkSession, manifest: Manifest, only: list[str] | None = None, skip: tuple[str, ...] = (), typology: DataFrame | None = None) -> dict[str, str]:
    """Validate, then make and write tables; name -> path.  Fleet stages run by the
    manifest's mode: ``auto`` if there are at least two cohorts."""
    obs = read_observations(spark, manifest.observations)
    report = validate_observations(obs)
    if not report.ok:
        raise InputError(report.summary())
    if typology is not None:
        obs = drop_constant_signals(obs, typology)
    fleet = manifest.mode == "force" or manifest.mode == "auto" and report.n_cohorts >= 2
    tables, written = {"observations": obs}, {}
    axis = manifest.signal_0["name"]
    for stage in plan(only, skip, fleet):
        made = stage.make(tables, manifest)
        written[stage.name] = write_table(made, manifest.output, stage.name, stage.units(axis) if stage.units else None)
        tables[stage.name] = read_table(spark, manifest.output, stage.name)
    return {k: v for k, v in written.items() if v}


def main(args: list[str] | None = None) -> int:
    """python -m orrery.plans.pipeline MANIFEST [--stages a,b] [--skip c]"""
    import argparse

    from ..session import session
    from ..sources.manifest import load_manifest

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("manifest")
    parser.add_argument("--stages", default="")
    parser.add_argument("--skip", default="")
    got = parser.parse_args(args)
    names = lambda x: [n for n in x.split(",") if n]
    for name, path in run(session(), load_manifest(got.manifest), names(got.stages) or None, tuple(names(got.skip))).items():
        print(f"{name}: {path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
