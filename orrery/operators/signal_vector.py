"""The feature vector: engines over trailing windows of every signal.

One exchange by (cohort, signal_id) makes the windows' arrays; one Arrow pass runs all
engines of a window, so that they share its clean copy.  A gate that skips an engine is
an expression over the typology, joined before the pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import frame_features
from ..functions.kernels import ENGINES, engine_outputs
from ..sources.manifest import Gate, Manifest
from .windows import SIGNAL, arrays, frame, framed, gathered, spread

KEYS = [*SIGNAL, "window_id", "signal_0_start", "signal_0_end", "signal_0_center", "n_obs"]
KEY_TYPES = "cohort string, signal_id string, window_id long, signal_0_start double, signal_0_end double, signal_0_center double, n_obs long"


def outputs_of(engines: list[str]) -> list[str]:
    """All engines' columns; a name that several have is the last one's."""
    return list(dict.fromkeys(c for e in engines for c in ENGINES[e][3]))


def window_size(base: int, least: int, most: int, factor: float, scale: str = "linear") -> int:
    """A base look-back scaled by a signal's window factor and kept within bounds."""
    grown = {"linear": factor, "sqrt": factor**0.5, "log2": float(np.log2(1 + factor))}[scale]
    return int(min(max(int(base * grown), least), most))


def _gated(windows: DataFrame, typology: DataFrame | None, gates: tuple[Gate, ...]) -> DataFrame:
    """Adds ``skip``: names of engines that a gate leaves out in this window."""
    if not gates:
        return windows.withColumn("skip", F.array().cast("array<string>"))
    have = set(typology.columns) if typology is not None else set()
    metrics = sorted({g.metric for g in gates if g.metric in have})
    if metrics:
        keys = [c for c in (*SIGNAL, "window_id") if c in have]
        windows = windows.join(typology.select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics]).dropDuplicates(keys), keys, "left")
    rules = []
    for g in gates:
        bad = F.lit(False)
        if g.metric in metrics:
            m = F.nanvl(F.col(f"__{g.metric}").cast("double"), F.lit(None))
            for bound, hit in ((g.gt, lambda b, m=m: m > b), (g.lt, lambda b, m=m: m < b)):
                if bound is not None:
                    bad = bad | F.coalesce(hit(bound), F.lit(False))
        if g.min_n_obs is not None:
            bad = bad | (F.col("n_obs") < g.min_n_obs)
        rules.append(F.when(bad, F.lit(g.engine)))
    return windows.withColumn("skip", F.array_compact(F.array(*rules))).drop(*[f"__{m}" for m in metrics])


def signal_vector(obs: DataFrame, window: int = 64, stride: int = 32, engines: list[str] | None = None, manifest: Manifest | None = None, typology: DataFrame | None = None, blocks: int = 0) -> DataFrame:
    """A row for each window: keys, ``engine_mask`` (bit i: the i-th engine by name ran),
    ``n_failed`` (engines that raised) and every engine's outputs; undefined and infinite values are null.  Engines look
    back their own number of rows from the window's end.  ``blocks``: for very long signals
    (see ``windows.numbered``)."""
    names = sorted(engines or ENGINES)
    back = {e: ENGINES[e][1] for e in names} | ({k: v for k, v in manifest.engine_windows.items() if k in names} if manifest else {})
    own: dict[tuple[str, str], dict[str, int]] = {}
    for cohort, signal, engine, size in manifest.overrides() if manifest else []:
        own.setdefault((cohort, signal), {})[engine] = size
    longest = max([window, *back.values(), *(w for o in own.values() for w in o.values())])
    rows = _gated(arrays(obs, window, stride, longest, blocks=blocks), typology, () if manifest is None or manifest.force_all else manifest.gates)
    columns = outputs_of(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cohort, signal, y, skip in zip(b["cohort"], b["signal_id"], b["y"], b["skip"], strict=True):
                sizes = back | own.get((cohort, signal), {})
                skipped = frozenset(skip)
                failed: list[str] = []
                row = engine_outputs(np.asarray(y, float), sizes, skipped, failed)
                row["n_failed"] = len(failed)
                row["engine_mask"] = sum(1 << i for i, e in enumerate(names) if e not in skipped and min(len(y), sizes[e]) >= ENGINES[e][2])
                out.append(row)
            made = pd.DataFrame(out, columns=["engine_mask", "n_failed", *columns], index=b.index)
            yield pd.concat([b[KEYS], made.replace([np.inf, -np.inf], np.nan)], axis=1)

    kinds = ", ".join(f"`{c}` double" for c in columns)
    made = spread(rows.select(*KEYS, "y", "skip")).mapInPandas(run, f"{KEY_TYPES}, engine_mask long, n_failed long, {kinds}")
    return made.select(*KEYS, "engine_mask", "n_failed", *[F.nanvl(c, F.lit(None)).alias(c) for c in columns])


def window_features(obs: DataFrame, window: int = 64, stride: int = 32) -> DataFrame:
    """The aggregates alone: moments, size and trend without any Python.  A frame is summed
    anew at every row, a group once for each window: windows that a row lies in up to
    eight of are groups."""
    if window <= 8 * stride:
        return gathered(obs, window, stride, frame_features(None))
    return framed(obs, window, stride, frame_features(frame(window)))


def rolling(obs: DataFrame, engine: str, window: int) -> DataFrame:
    """An engine over every window of ``window`` rows: its outputs stand at the window's
    last row and are null before the first window is full."""
    own = signal_vector(obs, window, 1, [engine], Manifest(engine_windows={engine: window}))
    made = own.select(*SIGNAL, F.col("signal_0_end").alias("signal_0"), *[F.col(c).alias(f"rolling_{c}") for c in ENGINES[engine][3]])
    return obs.join(made, [*SIGNAL, "signal_0"], "left")
