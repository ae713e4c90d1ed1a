"""Manifests (what to run on what) and layered configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

import yaml

#: Settings that apply where neither domain nor environment says otherwise.
DEFAULTS: dict[str, Any] = {
    "dynamics": {"smoothing": 3, "collapse": {"threshold_velocity": -0.05, "min_collapse_length": 3}},
    "geometry": {"min_signals": 2, "normalization": "zscore"},
    "pairwise": {"coloading_threshold": 0.1, "close_factor": 1.0},
    "windows": {"window": 64, "stride": 32},
}


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dictionaries merged key by key."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


class Config:
    """Defaults, then a domain's file, then an environment's; ``get`` takes dotted keys."""

    def __init__(self, folder: str | None = None, domain: str | None = None, environment: str | None = None):
        self.folder, self.domain, self.environment = folder, domain, environment
        self.reload()

    def _read(self, *parts: str) -> dict:
        path = os.path.join(self.folder or "", *parts)
        if not self.folder or not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}

    def reload(self) -> None:
        merged = DEFAULTS
        for layer in ("defaults.yaml", self.domain and f"domains/{self.domain}.yaml", self.environment and f"environments/{self.environment}.yaml"):
            if layer:
                merged = deep_merge(merged, self._read(*layer.split("/")))
        self._data = merged

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self._data
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def section(self, key: str) -> dict:
        found = self.get(key, {})
        return dict(found) if isinstance(found, dict) else {}

    def all(self) -> dict:
        return dict(self._data)


@dataclass(frozen=True)
class Gate:
    """Skip an engine where a typology metric is above or below a bound, or where there
    are too few observations.  A missing metric never skips."""

    engine: str
    metric: str | None = None
    gt: float | None = None
    lt: float | None = None
    min_n_obs: int | None = None


@dataclass(frozen=True)
class Manifest:
    observations: str = ""
    output: str = ""
    typology: str | None = None
    window: int = 64
    stride: int = 32
    mode: str = "auto"
    cohorts: dict[str, dict[str, dict]] = field(default_factory=dict)
    engine_windows: dict[str, int] = field(default_factory=dict)
    gates: tuple[Gate, ...] = ()
    signal_0: dict[str, str] = field(default_factory=lambda: {"name": "signal_0", "unit": "index"})
    intervention: float | None = None
    segments: tuple[tuple[str, float, float | None], ...] = ()
    force_all: bool = False

    def overrides(self) -> list[tuple[str, str, str, int]]:
        """(cohort, signal, engine, window) of the per-signal window overrides."""
        return [(c, s, e, int(w)) for c, own in self.cohorts.items() for s, spec in own.items() for e, w in ((spec or {}).get("engine_window_overrides") or {}).items()]


def parse_manifest(raw: dict, base: str = "") -> Manifest:
    """A manifest from its parsed YAML; relative paths are taken from ``base``."""
    if not isinstance(raw, dict):
        raise ValueError("a manifest is a mapping")
    paths, system = raw.get("paths") or {}, raw.get("system") or {}
    place = lambda p: p if not p or os.path.isabs(p) or "://" in p else os.path.join(base, p)
    gates = tuple(Gate(engine, g.get("metric"), g.get("gt"), g.get("lt"), g.get("min_n_obs")) for engine, own in (raw.get("engine_gates") or {}).items() for g in (own if isinstance(own, list) else [own]))
    cut = raw.get("intervention") or {}
    segments = tuple((s["name"], float(s["range"][0]), None if s["range"][1] is None else float(s["range"][1])) for s in raw.get("segments") or ())
    made = Manifest(
        observations=place(paths.get("observations", "")), output=place(paths.get("output_dir", "")), typology=place(paths.get("typology")) if paths.get("typology") else None,
        window=int(system.get("window", 64)), stride=int(system.get("stride", 32)), mode=system.get("mode", "auto"),
        cohorts=raw.get("cohorts") or {}, engine_windows={k: int(v) for k, v in (raw.get("engine_windows") or {}).items()}, gates=gates,
        signal_0={"name": "signal_0", "unit": "index"} | (raw.get("signal_0") or {}),
        intervention=float(cut["event_index"]) if cut.get("enabled") else None, segments=segments, force_all=bool(raw.get("_force_all")),
    )
    if made.window < 1 or made.stride < 1:
        raise ValueError("system.window and system.stride must be at least 1")
    if made.mode not in ("auto", "force", "skip"):
        raise ValueError(f"system.mode {made.mode!r} is none of auto, force, skip")
    return made


def load_manifest(path: str) -> Manifest:
    """From a YAML file, or from manifest.yaml in a folder."""
    path = os.path.join(path, "manifest.yaml") if os.path.isdir(path) else path
    with open(path, encoding="utf-8") as f:
        return parse_manifest(yaml.safe_load(f), os.path.dirname(os.path.abspath(path)))
