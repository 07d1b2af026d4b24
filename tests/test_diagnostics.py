"""Diagnostics from sums in Spark against the same in memory."""

import math

import numpy as np
import pytest

from meridia import sources as src
from meridia.functions import diagnostics as D
from meridia.span import Span

WINDOW = Span(0, 10_000)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    v, x = [], 50.0
    for _ in range(300):
        x = 20 + 0.6 * x + rng.standard_normal()
        v.append(x)
    rows = [(3 * i, 10, None if i in (7, 40) else float(y), float(y) - 50, float(y) + 1, "a" if i % 2 else "b") for i, y in enumerate(v)]
    p = src.table(spark.createDataFrame(rows, "time long, id int, x double, x_residual double, x_fitted double, k string"), order=("id",))
    return p, p.load(WINDOW), np.array([r[2] for r in rows if r[2] is not None])


def test_partial_correlations(made):
    p, df, v = made
    want = []
    for k in range(1, 13):
        X = np.column_stack([np.ones(len(v) - k), *[v[k - j : len(v) - j] for j in range(1, k + 1)]])
        want.append(np.linalg.lstsq(X, v[k:], rcond=None)[0][-1])
    assert D.pacf(p, df, "x", 12).data["pacf"] == pytest.approx([1.0, *want], abs=1e-8)
    assert [r["r"] for r in D.pacf_table(p, df, "x", 3).orderBy("lag").collect()] == pytest.approx([1.0, *want[:3]], abs=1e-8)


@pytest.mark.parametrize("kind", ["none", "constant", "trend"])
@pytest.mark.parametrize("lag", [0, 1, 5, None])
def test_unit_root(made, kind, lag):
    p, df, v = made
    n = len(v)
    k = int(12 * (n / 100) ** 0.25) if lag is None else lag
    dv = np.diff(v)
    m = len(dv) - k
    cols = [v[k:-1], *[dv[k - j : len(dv) - j] for j in range(1, k + 1)]]
    cols += [np.ones(m)] if kind != "none" else []
    cols += [np.arange(1.0, m + 1)] if kind == "trend" else []
    X = np.column_stack(cols)
    beta = np.linalg.lstsq(X, dv[k:], rcond=None)[0]
    e = dv[k:] - X @ beta
    stat = beta[0] / math.sqrt(e @ e / (m - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0])
    assert D.adf(p, df, "x", kind, lag).data["statistic"] == pytest.approx(stat, rel=1e-6)


def test_plots_of_long_columns(made, monkeypatch):
    p, df, v = made
    exact = D.qqplot(p, df, "x"), D.series(p, df, "x", maxpoints=40)
    monkeypatch.setattr(D, "DRIVER_ROWS", 100)
    rough = D.qqplot(p, df, "x", maxpoints=50), D.series(p, df, "x", maxpoints=40)
    assert rough[0].summary["correlation"] == pytest.approx(exact[0].summary["correlation"], abs=0.02)
    assert rough[0].summary["line"] == pytest.approx(exact[0].summary["line"])
    got = rough[1].data["x"]
    assert len(got["time"]) == 40 and max(got["value"]) == pytest.approx(v.max()) and got["time"] == sorted(got["time"])
    with pytest.raises(ValueError):
        D.column_vectors(p, df, "x")


def test_panel_tells_both_halves(made):
    p, df, v = made
    out = D.residual_panel(p, df, "x_residual", lags=5, fitstop=450)
    assert out.summary["insample"]["n"] == 150 and out.summary["outofsample"]["n"] == 150 and "fitted" in out.panels
    assert set(out.summary["ljungbox"]) == {10, 20, 40}
    none = D.residual_panel(p, df, "x", lags=5, fitstop=-1)
    assert none.summary["insample"] is None and any("out of sample" in w for w in none.warnings)


def test_vectors_and_keys(made):
    p, df, _ = made
    got = D.column_vectors(p, df, "time", "x", "time", key="k=a")
    assert got["time"][:3] == [3, 9, 15] and len(got["x"]) == 150
    assert D.key_values(df, ["k", "id"]) == [("b", 10), ("a", 10)]


def test_empty_and_constant(spark):
    p = src.table(spark.createDataFrame([], "time long, x double"))
    df = p.load(WINDOW)
    assert D.pacf(p, df, "x").data["pacf"] == [1.0] and D.adf(p, df, "x").summary["stationary"] is None and D.qqplot(p, df, "x").summary["n"] == 0
    p = src.table(spark.createDataFrame([(i, 2.0) for i in range(20)], "time long, x double"))
    df = p.load(WINDOW)
    assert D.adf(p, df, "x").summary["stationary"] is None and math.isnan(D.pacf_values(D.lag_sums(p, df, "x", 3), 3)[1])
