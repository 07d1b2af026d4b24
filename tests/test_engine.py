"""Reference semantics on small literal inputs, and registered queries against DuckDB."""

import glob
import math
import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__
from meridia import sources as src
from meridia.functions import arma
from meridia.functions import diagnostics as D
from meridia.functions import summarizers as S
from meridia.functions.special import chi2_tail
from meridia.operators import joins, rows, summarize, timeseries
from meridia.pipeline import Pipeline
from meridia.plans import queries as core
from meridia.span import Span

DATA = "/root/testdata/sf0.001"
WINDOW = Span(0, 100)


@pytest.fixture(scope="module")
def df(spark):
    rows_ = [(t, 1 + (t + 1) % 2, float(t), 2.0 * t + 1, None if t == 1 else float(t)) for t in range(1, 11)]
    return src.table(spark.createDataFrame(rows_, "time long, k long, x double, z double, y double"))


def times(p: Pipeline, span=WINDOW):
    return sorted(r["time"] for r in p.load(span).collect())


def test_moves(df):
    assert times(df | rows.lag(2)) == list(range(3, 13))
    assert times(df | rows.lead(1)) == list(range(0, 10))
    assert times(df | rows.set_time("time + 1")) == list(range(2, 12))
    assert (df | rows.lead(1)).acausal and not (df | rows.lag(1)).acausal
    with pytest.raises(Exception, match="earlier"):
        times(df | rows.set_time("time - 1"))


def test_columns(df):
    assert (df | rows.drop_columns(match="^[kx]$")).load(WINDOW).columns == ["time", "z", "y"]
    with pytest.raises(ValueError, match="empty"):
        (df | rows.select_columns()).load(WINDOW)
    with pytest.raises(ValueError, match="exist"):
        (df | rows.add_columns(x="1")).load(WINDOW)


def test_windows(spark, df):
    rolled = (df | summarize.add_rolling_columns({"w": 2}, S.Sum("x"))).load(WINDOW)
    assert {r["time"]: r["w_x_sum"] for r in rolled.collect()}[5] == 12
    twelve = Span(0, 12)
    tumbling = (df | summarize.intervalize(src.clock(spark, 5), S.Count())).load(twelve).orderBy("time").collect()
    assert [r["count"] for r in tumbling] == [4, 5]
    for interval in (None, 5):
        hopping = (df | summarize.summarize_windows(src.clock(spark, 5), 5, S.Count(), interval=interval)).load(twelve).orderBy("time").collect()
        assert [r["count"] for r in hopping] == [0, 4, 5]
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    dense = (df | summarize.intervalize(src.clock(spark, 5), S.Count(), key="k", keyset=keys)).load(twelve).orderBy("time", "k").collect()
    assert [r["count"] for r in dense] == [2, 2, 0, 3, 2, 0]
    dense = (df | summarize.summarize_windows(src.clock(spark, 5), 5, S.Count(), key="k", keyset=keys)).load(twelve).orderBy("time", "k").collect()
    assert [r["count"] for r in dense] == [0, 0, 0, 2, 2, 0, 3, 2, 0]


def test_asof(spark, df):
    quotes = src.table(spark.createDataFrame([(0, 1.0), (5, 2.0)], "time long, q double"))
    got = [r["q"] for r in (df | joins.asof_join(quotes)).load(WINDOW).orderBy("time").collect()]
    assert got == [1.0] * 4 + [2.0] * 6
    got = [r["q"] for r in (df | joins.future_join(quotes)).load(WINDOW).orderBy("time").collect()]
    assert got == [2.0] * 5 + [None] * 5


def test_final_states(df):
    got = (df | summarize.summarize(S.Lags("x", 2), S.EMA("x", span=3, kind="bigint"))).load(WINDOW).first()
    s = 1.0
    for v in range(2, 11):
        s += 0.5 * (v - s)
    assert (got["x_lag_1"], got["x_lag_2"]) == (9.0, 8.0) and got["x_ema_3"] == pytest.approx(s)


def test_closed_reads(spark):
    t = spark.createDataFrame([(1, 1.0), (5, 2.0)], "time long, x double")
    assert times(src.table(t), Span(0, 5)) == [1] and times(src.table(t, closed=True), Span(0, 5)) == [1, 5]


def test_files(spark, df, tmp_path):
    sink = src.write_parquet(f"{tmp_path}/t.parquet")
    sink.write(df | sink, WINDOW)
    assert times(src.read_parquet(spark, f"{tmp_path}/t.parquet")) == list(range(1, 11))
    src.write_csv(f"{tmp_path}/t.csv").write(df, WINDOW)
    assert times(src.read_csv(spark, f"{tmp_path}/t.csv", types={"time": "long"})) == list(range(1, 11))
    src.save_table(df.load(WINDOW), str(tmp_path), "snap", WINDOW)
    assert src.read_snapshot(spark, str(tmp_path), "snap")[1] == WINDOW
    with pytest.raises(ValueError):
        src.load_table(spark, "x.json")


def test_regression_poisons(df):
    whole = (df | summarize.summarize(S.LinearRegression("x", "k", response="z"))).load(WINDOW).first()
    assert whole["x_beta"] == pytest.approx(2) and whole["n"] == 10
    poisoned = (df | summarize.summarize(S.LinearRegression("y", response="z"))).load(WINDOW).first()
    assert poisoned["y_beta"] is None


def test_insample_arma_and_models(spark, df):
    p = df | timeseries.insample_arma("x", (1, 0, 0))
    assert p.acausal and "x_residual" in p.load(WINDOW).columns

    with pytest.raises(TypeError):
        timeseries.fit_model(object(), ["x"], "z")


def test_arma_recovers():
    rng = np.random.default_rng(1)
    e, y = rng.standard_normal(600), [0.0]
    for t in range(1, 600):
        y.append(0.6 * y[-1] + e[t] + 0.3 * e[t - 1])
    m = arma.fit(y, (1, 0, 1))
    assert m["status"] == "ok" and m["coefs"][0] == pytest.approx(0.6, abs=0.12) and m["coefs"][1] == pytest.approx(0.3, abs=0.15)
    assert arma.fit([math.nan] * 5, (1, 0, 0))["status"] == "failed"
    out, ahead, state = arma.apply(m, np.array(y), horizon=2)
    a, _, s = arma.apply(m, np.array(y[:300]))
    b, _, _ = arma.apply(m, np.array(y[300:]), s)
    assert np.allclose(np.r_[a, b], out, equal_nan=True) and ahead.shape == (600, 2)
    assert arma.fit(np.cumsum(y), (1, 1, 0))["status"] == "ok"


def test_diagnostics(spark, df):
    frame = df.load(WINDOW)
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert D.acf(df, frame, "x", 3).data["acf"][0] == 1.0
    assert len(D.pacf(df, frame, "x", 3).data["pacf"]) == 4
    assert D.ljung_box(df, frame, "x", (3, 40)).warnings
    assert D.adf(df, frame, "x").summary["n"] == 10
    assert D.histogram(df, frame, "y").summary["dropped"] == 1
    assert D.qqplot(df, frame, "x").summary["n"] == 10
    assert D.series(df, frame, "x").summary["rows"] == 10
    assert D.result_summary(df, frame).data["columns"]["y"]["missing"] == 1
    assert D.spacing(df, frame)["regular"]
    assert list(D.lttb(np.arange(10.0), np.arange(10.0), 2)) == list(range(10))
    assert len(D.lttb(np.arange(1000.0), np.sin(np.arange(1000.0)), 50)) == 50
    assert D.forecast_fan(df, frame, "x", arma.fit(np.arange(10.0) % 3, (1, 0, 0)), 3).summary["h"] == 3


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(pdf):
    pdf = pdf[sorted(pdf)]
    for c in pdf:
        if pdf[c].dtype.kind == "M":
            pdf[c] = pdf[c].astype("datetime64[us]")
    pdf = pdf.astype(object).where(pdf.notna(), None)
    return sorted(map(str, pdf.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_oracle(spark, con, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), con.execute(core.ORACLE[name]).df()
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert core.MONTH.start == datetime(2024, 1, 1) and core.DAY == timedelta(days=1)
