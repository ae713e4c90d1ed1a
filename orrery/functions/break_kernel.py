"""Structural breaks of one series: CUSUM, local derivative and local spikes."""

from __future__ import annotations

import numpy as np

MAD = 1.4826


def _fill(y: np.ndarray) -> np.ndarray:
    good = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(good), y[good]) if good.any() else np.zeros(0)


def _around(y: np.ndarray, half: int) -> np.ndarray:
    """(n, 2 half) values of [i - half, i + half), NaN outside the series."""
    padded = np.concatenate([np.full(half, np.nan), y, np.full(half, np.nan)])
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * half)[: len(y)]


def noise_floor(y: np.ndarray, half: int = 25) -> np.ndarray:
    w = _around(y, half)
    noise = MAD * np.nanmedian(np.abs(w - np.nanmedian(w, 1, keepdims=True)), 1)
    return np.where(noise <= 1e-10, 1.0, noise)


def find_breaks(y, sensitivity: float = 1.0, context: int = 50, spacing: int = 10, half: int = 25) -> list[dict[str, float]]:
    """Breaks in order of place: index, magnitude, direction, sharpness, duration, levels
    before and after, signal to noise.  Series under 2 ``context`` + 10 have none."""
    y = _fill(np.asarray(y, float))
    n = len(y)
    if n < 2 * context + 10 or np.ptp(y) <= 1e-12:
        return []
    noise = noise_floor(y, half)
    hits: list[tuple[int, float]] = []
    mean, up, down, limit = y[0], 0.0, 0.0, 4.0 / sensitivity
    for i in range(1, n):  # the running mean depends on every reset before it
        z = (y[i] - mean) / noise[i]
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
        if max(up, down) > limit:
            hits.append((i, max(up, down)))
            mean, up, down = y[i], 0.0, 0.0
        else:
            mean += 0.05 * (y[i] - mean)
    jump = np.abs(np.diff(y)) / noise[1:]
    hits += [(int(i) + 1, float(jump[i])) for i in np.flatnonzero(jump > 5.0 / sensitivity)]
    w = _around(y, half).copy()
    w[:, half] = np.nan
    centre = np.nanmedian(w, 1)
    spread = MAD * np.nanmedian(np.abs(w - centre[:, None]), 1)
    spike = np.abs(y - centre) / np.where(spread <= 1e-10, 1.0, spread)
    hits += [(int(i), float(spike[i])) for i in np.flatnonzero(spike > 5.0 / sensitivity)]
    kept: list[tuple[int, float]] = []
    for place, score in sorted(hits):
        if kept and place - kept[-1][0] < spacing:
            if score > kept[-1][1]:
                kept[-1] = (place, score)
        else:
            kept.append((place, score))
    out = []
    for place, _ in kept:
        before, after = y[max(0, place - context) : place], y[place : place + context]
        if not len(before) or not len(after):
            continue
        pre, post = float(np.median(before)), float(np.median(after))
        step = post - pre
        if abs(step) < abs(y[place] - pre) and abs(step) <= 3 * noise[place]:
            step = float(y[place] - pre)  # an impulse: the level comes back
        settled = np.flatnonzero(np.abs(y[place : place + 20] - (pre + step)) <= max(0.1 * abs(step), noise[place]))
        duration = int(settled[0]) + 1 if len(settled) else min(20, n - place)
        scale = max(float(noise[place]), 1e-10)
        out.append({"index": place, "magnitude": float(step), "direction": int(np.sign(step)), "sharpness": float(abs(step) / duration), "duration": duration, "pre_level": pre, "post_level": post, "snr": float(abs(step) / scale)})
    return out


def summarise(found: list[dict[str, float]]) -> dict[str, float]:
    if not found:
        return {"n_breaks": 0, "mean_spacing": np.nan, "mean_magnitude": np.nan, "max_magnitude": np.nan, "mean_sharpness": np.nan, "max_sharpness": np.nan}
    place, size, sharp = (np.array([b[k] for b in found], float) for k in ("index", "magnitude", "sharpness"))
    return {"n_breaks": len(found), "mean_spacing": float(np.diff(place).mean()) if len(place) > 1 else np.nan, "mean_magnitude": float(np.abs(size).mean()), "max_magnitude": float(np.abs(size).max()), "mean_sharpness": float(sharp.mean()), "max_sharpness": float(sharp.max())}
