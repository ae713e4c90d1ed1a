import numpy as np
import pytest

from orrery.functions.break_kernel import find_breaks, summarise


@pytest.mark.parametrize(("before", "after", "direction"), [(10.0, 20.0, 1), (30.0, 10.0, -1)])
def test_steps(before, after, direction):
    found = find_breaks(np.repeat([before, after], 500))
    near = [b for b in found if abs(b["index"] - 500) <= 20]
    assert near and near[0]["direction"] == direction and near[0]["duration"] <= 5


def test_impulse():
    y = 0.5 * np.random.default_rng(42).normal(size=1000)
    y[500] = 50
    assert any(abs(b["index"] - 500) <= 5 and b["snr"] > 10 for b in find_breaks(y, 1.5))


def test_noise_has_few():
    assert len(find_breaks(np.random.default_rng(42).normal(size=1000), 0.5)) < 5


def test_levels_and_ramp():
    found = [b["index"] for b in find_breaks(np.repeat([0.0, 10, 5, 15, 8], 200))]
    assert sum(any(abs(i - k) <= 20 for i in found) for k in (200, 400, 600, 800)) >= 3
    assert find_breaks(np.concatenate([np.zeros(400), np.linspace(0, 10, 100), np.full(500, 10.0)]))


@pytest.mark.parametrize("y", [[], [1.0, 2, 3], np.ones(1000)])
def test_none(y):
    assert find_breaks(y) == []


def test_missing_values():
    y = np.ones(300)
    y[[10, 200]] = np.nan
    assert len(find_breaks(y)) <= 1


def test_summary():
    s = summarise([{"index": i, "magnitude": m, "sharpness": k} for i, m, k in ((100, 5, 1), (200, -3, 1.5), (350, 4, 2))])
    assert s["n_breaks"] == 3 and s["mean_spacing"] == 125 and s["max_magnitude"] == 5 and s["mean_sharpness"] == 1.5
