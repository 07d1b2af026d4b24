"""Registered queries on odd values, and on more rows than one task, one cell or the driver should have to take."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from meridia import sources as src
from meridia.functions import arma as A
from meridia.functions import summarizers as S
from meridia.operators import summarize
from meridia.span import Span

START = datetime(2024, 1, 5)


def tables(spark, folder, values, kind="click", step=timedelta(minutes=1)):
    rows = [(i, START + step * i, i % 7, kind, v, "") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, name, folder):
    got = entry.queries()[name](spark, folder)
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = c.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_logtransform_of_odd_values(spark, tmp_path):
    inf = float("inf")
    got, want = both(spark, "logtransform", tables(spark, tmp_path, [None, -2.5, 0.0, -0.0, 1.0, 3.7, float("nan"), inf, -inf, 1e-300]))
    assert list(map(repr, got)) == list(map(repr, want))


def test_columnvectors_beyond_the_driver(spark, tmp_path):
    n = 60_000
    folder = tables(spark, tmp_path, [i / 100 for i in range(n)], "purchase", timedelta(seconds=10))
    got, want = both(spark, "columnvectors", folder)
    assert len(got) == n and got == want
    assert [r["event_id"] for r in entry.queries()["columnvectors"](spark, folder).take(3)] == [0, 1, 2]


SHAPES = [((1, 0, 1), (0, 0, 0, 0), [5, 0.6, 0.3, 1.0]), ((2, 1, 1), (0, 0, 0, 0), [5, 0.3, 0.1, 0.3, 1.0]), ((1, 0, 1), (1, 1, 0, 4), [5, 0.6, 0.3, 0.2, 2.0])]


@pytest.mark.parametrize("order, seasonal, coefs", SHAPES)
def test_settled_filter_is_the_filter(monkeypatch, order, seasonal, coefs):
    y = np.random.default_rng(1).standard_normal(2500).cumsum()
    y[100:103] = y[1400] = np.nan
    system = A.system(order, seasonal, True, coefs)
    fast = A.kalman(y, *system)
    calls = []
    monkeypatch.setattr(A, "_settled", lambda *a: calls.append(len(a[0])))
    monkeypatch.setattr(A, "SETTLED_ROWS", len(y) + 1)
    slow = A.kalman(y, *system)
    assert not calls
    for a, b in zip(fast[:3], slow[:3]):
        np.testing.assert_allclose(a, b, rtol=0, atol=1e-8)
    assert fast[3] == pytest.approx(slow[3], rel=1e-10) and fast[4] == slow[4]
    np.testing.assert_allclose(fast[5][0], slow[5][0], atol=1e-8)


def test_white_noise_has_its_closed_form():
    y = np.r_[np.random.default_rng(2).standard_normal(1_000_000) + 3, np.nan]
    m = A.fit(y, (0, 0, 0), mean=True)
    var = np.nanvar(y)
    assert m["nobs"] == 1_000_000 and m["coefs"] == pytest.approx([np.nanmean(y), var], rel=1e-12)
    assert m["loglik"] == pytest.approx(-0.5e6 * (np.log(2 * np.pi * var) + 1), rel=1e-12)
    assert A.fit([1e200, -1e200], (0, 0, 0))["status"] == "failed" and A.fit([2.0, 2.0], (0, 0, 0), mean=True)["status"] == "ok"


def test_long_series_are_fitted():
    """A pass over the rows one by one for each likelihood would take hours."""
    rng = np.random.default_rng(3)
    e, y = rng.standard_normal(300_000), np.zeros(300_000)
    for t in range(1, len(y)):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    assert A.fit(y, (1, 0, 1))["coefs"] == pytest.approx([0.6, 0.3, 1.0], abs=0.01)


def test_fits_in_hopping_windows(spark, tmp_path):
    """Counts and estimates of 40000 rows, each in one or two windows (a loop over them took minutes)."""
    values = np.random.default_rng(4).exponential(50, 40_000).round(2).tolist()
    got, want = both(spark, "fitarma_summarizer", tables(spark, tmp_path, values, step=timedelta(seconds=30)))
    assert [r[:3] for r in got] == [r[:3] for r in want] and sum(r[2] for r in got) > 40_000
    np.testing.assert_allclose([r[3:] for r in got], [r[3:] for r in want], atol=2e-3)


@pytest.mark.parametrize("mean", [True, False])
def test_white_noise_is_told_from_sums(spark, mean):
    """The same models as from the rows, whose plan gathers no rows of a fit."""
    inf, nan = float("inf"), float("nan")
    groups = [[1.5, 2.0, None, 7.25, nan, -3.0], [4.0], [4.0, 4.0, 4.0], [None, nan, inf], [1e200, -1e200], [1e308, 1e308], [0.1] * 7 + [-inf], [2.0, 3.0, 5.0], [5.0, 2.0, None, 3.0]]
    rows = [(i, g, v) for g, vs in enumerate(groups) for i, v in enumerate(vs)]
    p = src.table(spark.createDataFrame(rows, "time long, g long, v double"))
    out = (p | summarize.summarize(S.FitARMA("v", (0, 0, 0), include_mean=mean), key="g")).load(Span(0, 100))
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [f.simpleString() for f in out.schema["model"].dataType] == [f.simpleString() for f in spark.createDataFrame([], A.MODEL_SCHEMA).schema]
    got = {r["g"]: r["model"].asDict() for r in out.collect()}
    assert set(got) == set(range(len(groups)))
    for g, vs in enumerate(groups):
        want = A.fit([nan if v is None else v for v in vs], (0, 0, 0), mean=mean)
        for f in A.FIELDS[:-1]:
            if want[f] is None or isinstance(want[f], (str, bool)) or f in ("order", "seasonal_order", "names", "nobs"):
                assert got[g][f] == want[f], (g, f)
            else:
                assert got[g][f] == pytest.approx(want[f], rel=1e-9, abs=1e-290, nan_ok=True), (g, f)
    ids = [got[g]["model_id"] for g in range(len(groups))]
    assert all(len(i) == 16 for i in ids) and ids[7] == ids[8] and len(set(ids)) == len(ids) - 1
    none = p.then(lambda df, _: df.where("false")) | summarize.summarize(S.FitARMA("v", (0, 0, 0), include_mean=mean))
    assert [(r["model"]["status"], r["model"]["nobs"]) for r in none.load(Span(0, 100)).collect()] == [("failed", 0)]


MERGING = (S.Count(), S.Sum("x"), S.Mean("x"), S.Min("x"), S.Max("y"), S.SumPower("x", 2), S.DotProduct("x", "y"), S.Product("x"))


@pytest.mark.parametrize("span", [Span(0, 5000), Span(0, 40), Span(-(10**7), 10**7)])
def test_trailing_pieces_as_with_a_key(spark, span):
    rng = np.random.default_rng(5)
    at = np.where(rng.random(500) < 0.3, rng.integers(0, 40, 500), rng.integers(0, 5000, 500)).tolist()
    rows = [(t, i, 1, None if i % 9 == 0 else float(rng.integers(1, 4)), i % 13) for i, t in enumerate(at)]
    p = src.table(spark.createDataFrame(rows, "time long, id long, one int, x double, y long"), order=("id",))
    roll = lambda key: summarize.add_rolling_columns({"a": 1, "b": 37, "c": 1501, "d": 10**6}, *MERGING, key=key)
    got, want = ((p | roll(k)).load(span) for k in (None, "one"))
    assert got.schema.simpleString() == want.schema.simpleString() and "RangeFrame, -1501" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in df.drop("x").collect())
    assert repr(near(got)) == repr(near(want))
    ends = (p | summarize.add_rolling_columns({"b": 37}, S.First("y"), S.Last("y"))).load(span).collect()
    inside = sorted(r for r in rows if span.start - 37 <= r[0] < span.stop)
    for r in ends:
        window = [q for q in inside if r["time"] - 37 <= q[0] <= r["time"]]
        assert (r["b_y_first"], r["b_y_last"]) == (window[0][4], window[-1][4])


def test_trailing_window_of_crowded_time(spark, tmp_path):
    """No frame slides over a window's rows: their number would count at every row."""
    values = np.random.default_rng(6).exponential(50, 20_000).round(2).tolist()
    folder = tables(spark, tmp_path, values, step=timedelta(milliseconds=500))
    got, want = both(spark, "addrollingcolumns_unkeyed", folder)
    assert got == want
    assert "RangeFrame, -21600000000" not in entry.queries()["addrollingcolumns_unkeyed"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
