import numpy as np
import pytest

from geoloom.operators import raster as ra


def dense_spline(x, y, at):
    h, m = np.diff(x), np.zeros(len(x))
    a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(y) / h))
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    t, u = at - x[k], x[k + 1] - at
    return (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


def test_spline_solves_long_series():
    x = np.arange(200_000.0)  # a dense system of these has 320 GB
    assert np.allclose(ra.natural_spline(x, np.sin(x / 50), x[:-1] + 0.5), np.sin((x[:-1] + 0.5) / 50), atol=1e-4)


@pytest.mark.parametrize("knots, points, dx, window", [(150, 40, 0.4, 3.0), (150, 40, 0.4, 40.0), (2048, 4096, 5.0, 20.0)])
def test_spline_average_in_blocks(spark, monkeypatch, knots, points, dx, window):
    monkeypatch.setattr(ra, "KNOTS", knots)
    monkeypatch.setattr(ra, "POINTS", points)
    rng, rows, want = np.random.default_rng(4), [], {}
    for name, n in (("a", 700), ("b", 151), ("c", 4), (None, 301), ("e", 1)):
        x = np.unique(rng.choice(3 * n, n)) / 3 + (rng.random() if n > 1 else 0)
        y = rng.random(len(x))
        rows += [(name, float(p), float(q)) for p, q in zip(x, y)]
        m = int(round((x[-1] - x[0]) / dx)) if len(x) > 1 else 0
        if m < 2:
            continue
        at = np.linspace(x[0], x[-1], m)
        w = max(1, min(m, int(round(window / ((x[-1] - x[0]) / m)))))
        smooth = dense_spline(x, y, at) if len(x) > 2 else np.interp(at, x, y)
        ma = np.convolve(smooth, np.ones(w), "valid") / w
        want[name] = (at[-len(ma) :], ma)
    got = ra.spline_average(spark.createDataFrame(rows, "k string, x double, y double"), "k", dx, window).collect()
    assert {r.k for r in got} == set(want)
    for name, (at, ma) in want.items():
        mine = sorted((r.x, r.y) for r in got if r.k == name)
        assert np.allclose([p for p, _ in mine], at) and np.allclose([q for _, q in mine], ma, atol=1e-9)
