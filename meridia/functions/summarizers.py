"""Summarizers: named aggregates that work under groups and over windows.

Nulls are skipped, as in SQL, except by ``LinearRegression``, whose outputs turn null when a predictor or the
response is.  Every summarizer gives (output name, group aggregate, window aggregate) triples; the window form
takes the window, the group form the rank struct that orders rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import arma as A
from meridia.span import number, width


@dataclass(frozen=True)
class Output:
    name: str
    group: Callable[[Column], Column]  # of the rank struct
    over: Callable[[WindowSpec], Column]
    empty: object = None


@dataclass(frozen=True)
class Summarizer:
    label: str
    columns: tuple[str, ...]
    outputs: tuple[Output, ...]
    finish: tuple = field(default=(), compare=False)  # (name, Column) computed after the aggregation; inputs are dropped
    params: dict = field(default_factory=dict, compare=False)


def _plain(label: str, columns: tuple[str, ...], name: str, make: Callable[[], Column], empty=None) -> Summarizer:
    return Summarizer(label, columns, (Output(name, lambda _: make(), lambda w: make().over(w), empty),))


def Count() -> Summarizer:
    return _plain("Count", (), "count", lambda: F.count(F.lit(1)), 0)


def CountDistinct(x: str) -> Summarizer:
    one = Output(f"{x}_countdistinct", lambda _: F.countDistinct(x), lambda w: F.size(F.collect_set(x).over(w)).cast("long"), 0)
    return Summarizer("CountDistinct", (x,), (one,))


def Sum(x: str) -> Summarizer:
    return _plain("Sum", (x,), f"{x}_sum", lambda: F.sum(x))


def Product(x: str) -> Summarizer:
    return _plain("Product", (x,), f"{x}_product", lambda: F.product(F.col(x)))


def Mean(x: str) -> Summarizer:
    return _plain("Mean", (x,), f"{x}_mean", lambda: F.avg(x))


def Min(x: str) -> Summarizer:
    return _plain("Min", (x,), f"{x}_min", lambda: F.min(x))


def Max(x: str) -> Summarizer:
    return _plain("Max", (x,), f"{x}_max", lambda: F.max(x))


def First(x: str) -> Summarizer:
    return Summarizer("First", (x,), (Output(f"{x}_first", lambda r: F.min_by(x, r), lambda w: F.first(x).over(w)),))


def Last(x: str) -> Summarizer:
    return Summarizer("Last", (x,), (Output(f"{x}_last", lambda r: F.max_by(x, r), lambda w: F.last(x).over(w)),))


def SumPower(x: str, n: int) -> Summarizer:
    return _plain("SumPower", (x,), f"{x}_sumpower_{n}", lambda: F.sum(F.pow(F.col(x), F.lit(float(n)))))


def Moment(x: str, n: int) -> Summarizer:
    """The raw moment."""
    return _plain("Moment", (x,), f"{x}_moment_{n}", lambda: F.avg(F.pow(F.col(x), F.lit(float(n)))))


def Variance(x: str, corrected: bool = True) -> Summarizer:
    return _plain("Variance", (x,), f"{x}_variance", lambda: (F.var_samp if corrected else F.var_pop)(x))


def Std(x: str, corrected: bool = True) -> Summarizer:
    return _plain("Std", (x,), f"{x}_std", lambda: (F.stddev_samp if corrected else F.stddev_pop)(x))


def DotProduct(x: str, y: str) -> Summarizer:
    return _plain("DotProduct", (x, y), f"{x}_{y}_dotproduct", lambda: F.sum(F.col(x) * F.col(y)))


def Correlation(x: str, y: str) -> Summarizer:
    return _plain("Correlation", (x, y), f"{x}_{y}_correlation", lambda: F.corr(x, y))


def Covariance(x: str, y: str, corrected: bool = True) -> Summarizer:
    return _plain("Covariance", (x, y), f"{x}_{y}_covariance", lambda: (F.covar_samp if corrected else F.covar_pop)(x, y))


def solve_gram(n: float, gram: np.ndarray, xy: np.ndarray, yy: float, intercept: bool) -> np.ndarray:
    """Coefficients, then r2, from sums of products; NaN where the system is singular."""
    k = len(xy)
    try:
        if n < k or np.linalg.matrix_rank(gram) < k:
            raise np.linalg.LinAlgError
        beta = np.linalg.solve(gram, xy)
    except np.linalg.LinAlgError:
        return np.full(k + 1, np.nan)
    rss = max(0.0, yy - float(beta @ xy))
    tss = yy - (xy[0] ** 2 / n if intercept else 0.0)
    return np.append(beta, 1 - rss / tss if tss > 0 else np.nan)


def _line(x: str, y: str, prefix: str) -> Summarizer:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    parts = {"a": F.regr_intercept(b, a), "b": F.regr_slope(b, a), "r2": F.regr_r2(b, a), "syy": F.regr_syy(b, a), "n": F.count(F.lit(1)), "whole": F.count_if(whole)}
    raw = f"#line_{prefix}{y}_{x}"
    one = Output(raw, lambda _: F.struct(*[c.alias(n) for n, c in parts.items()]), lambda w: F.struct(*[c.over(w).alias(n) for n, c in parts.items()]))
    ok = (F.col(raw)["n"] == F.col(raw)["whole"]) & F.col(raw)["b"].isNotNull()
    shown = {"intercept_beta": F.when(ok, F.col(raw)["a"]), f"{x}_beta": F.when(ok, F.col(raw)["b"]), "r2": F.when(ok & (F.col(raw)["syy"] != 0), F.col(raw)["r2"]), "n": F.col(raw)["n"]}
    return Summarizer("LinearRegression", (x, y), (one,), tuple((prefix + n, c) for n, c in shown.items()))


def LinearRegression(*predictors: str, response: str, intercept: bool = True, name: str | None = None) -> Summarizer:
    """Least squares by one pass of sums of products, which merge; a tiny solve per output row.  One predictor with an
    intercept takes the built-in regressions, so running forms stay in the JVM too."""
    if not predictors:
        raise ValueError("needs one predictor at least")
    prefix = f"{name}_" if name else ""
    if len(predictors) == 1 and intercept:
        return _line(predictors[0], response, prefix)
    terms = [F.lit(1.0)] * intercept + [F.col(p).cast("double") for p in predictors]
    y, k = F.col(response).cast("double"), len(predictors) + intercept
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [terms[i] * terms[j] for i, j in pairs] + [t * y for t in terms] + [y * y]
    whole = F.lit(True)
    for c in (*predictors, response):
        whole = whole & F.col(c).isNotNull()
    sums = lambda f: F.array(*[f(F.sum(x)) for x in products], f(F.count(F.lit(1))).cast("double"), f(F.count_if(whole)).cast("double"))
    raw = f"#gram_{prefix}{response}_{'_'.join(predictors)}"

    @F.pandas_udf("array<double>")
    def solved(g: pd.Series) -> pd.Series:
        out = []
        for row in g:
            if row is None:
                out.append(None)
                continue
            row = np.array([np.nan if v is None else v for v in row], float)
            m, n, full = len(pairs), row[-2], row[-1]
            gram = np.empty((k, k))
            for v, (i, j) in zip(row[:m], pairs):
                gram[i, j] = gram[j, i] = v
            ok = n and n == full
            out.append((solve_gram(n, gram, row[m : m + k], row[m + k], intercept) if ok else np.full(k + 1, np.nan)).tolist() + [n, full])
        return pd.Series(out)

    labels = ["intercept"] * intercept + list(predictors)
    out = f"#beta_{prefix}{response}"
    finish = [(out, solved(F.col(raw)))]
    bad = F.col(out)[k + 1] != F.col(out)[k + 2]
    for i, label in enumerate(labels):
        finish.append((f"{prefix}{label}_beta", F.when(~bad, F.col(out)[i])))
    finish += [(f"{prefix}r2", F.when(~bad, F.col(out)[k])), (f"{prefix}n", F.col(out)[k + 1].cast("long"))]
    one = Output(raw, lambda _: sums(lambda a: a), lambda w: sums(lambda a: a.over(w)))
    return Summarizer("LinearRegression", (*predictors, response), (one,), tuple(finish))


def Lags(x: str, p: int, name: str | None = None) -> Summarizer:
    """Values 1..p rows behind the last row of a group or window.  ``summarize`` cuts every group to its last ``p + 1`` rows
    before they are gathered."""
    if p < 1:
        raise ValueError("p must be 1 or more")
    label = name or f"{x}_lag"

    def back(i: int) -> Output:
        value = F.struct(F.col(x).alias("v"))
        listed = lambda r: F.try_element_at(F.reverse(F.array_sort(F.collect_list(F.struct(r.alias("r"), F.col(x).alias("v"))))), F.lit(i + 1))
        return Output(f"{label}_{i}", lambda r: listed(r)["v"], lambda w: F.try_element_at(F.collect_list(value).over(w), F.lit(-i - 1))["v"])

    return Summarizer("Lags", (x,), tuple(back(i) for i in range(1, p + 1)), params={"p": p})


def ema_label(x: str, span=None, halflife=None) -> str:
    if (span is None) == (halflife is None):
        raise ValueError("give either span or halflife")
    if span is not None:
        if span < 1:
            raise ValueError("span must be 1 or more")
        return f"{x}_ema_{span}"
    if hasattr(halflife, "total_seconds"):
        seconds = halflife.total_seconds()
        for unit, size in (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)):
            if seconds % size == 0:
                return f"{x}_ema_hl_{int(seconds // size)}{unit}"
        return f"{x}_ema_hl_{int(seconds * 1000)}millisecond"
    return f"{x}_ema_hl_{halflife}"


def EMA(x: str, span=None, halflife=None, name: str | None = None, kind: str = "timestamp_ntz") -> Summarizer:
    """Exponential average of a group's or a window's rows, folded in order.  Running averages go through the operator
    ``ema``, which doesn't fold anew at every row."""
    label = name or ema_label(x, span, halflife)
    at = number(F.col("time"), kind).cast("double") if halflife is not None else F.lit(0.0)

    def fold(rows: Column) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("v"))

        def step(s: Column, e: Column) -> Column:
            alpha = F.lit(2.0 / (span + 1)) if span is not None else 1 - F.exp(F.lit(-math.log(2)) * (e["t"] - s["t"]) / F.lit(float(width(halflife, kind))))
            return F.struct(e["t"].alias("t"), F.when(s["v"].isNull(), e["v"]).otherwise(s["v"] + alpha * (e["v"] - s["v"])).alias("v"))

        return F.aggregate(F.filter(rows, lambda s: s["v"].isNotNull()), start, step)["v"]

    value = F.col(x).cast("double").alias("v")
    group = lambda r: fold(F.array_sort(F.collect_list(F.struct(r.alias("r"), at.alias("t"), value))))
    over = lambda w: fold(F.collect_list(F.struct(at.alias("t"), value)).over(w))
    return Summarizer("EMA", (x,), (Output(label, group, over),), params={"span": span, "halflife": halflife, "name": label})


def FitModel(model: Any, predictors: list[str] | str, response: str, name: str = "model") -> Summarizer:
    """A model with ``fit(X, y)`` on the complete rows of a group or window, as one binary cell; null without one.

    The rows of one fit are gathered into one cell: a fit needs them together.
    """
    if not hasattr(model, "fit") or not hasattr(model, "predict"):
        raise TypeError("a model has fit and predict")
    xs, blob = [predictors] if isinstance(predictors, str) else list(predictors), cloudpickle.dumps(model)
    raw = f"#rows_{name}"

    @F.pandas_udf("binary")
    def fitted(rows: pd.Series) -> pd.Series:
        out = []
        for group in rows:
            got = np.array([[math.nan if v is None else v for v in r["v"]] for r in (group if group is not None else ())], float).reshape(-1, len(xs) + 1)
            got = got[~np.isnan(got).any(axis=1)]
            if len(got):
                m = pickle.loads(blob)
                m.fit(got[:, :-1], got[:, -1])
            out.append(cloudpickle.dumps(m) if len(got) else None)
        return pd.Series(out, dtype=object)

    values = F.array(*[F.col(c).cast("double") for c in (*xs, response)]).alias("v")
    one = Output(raw, lambda r: F.array_sort(F.collect_list(F.struct(r.alias("r"), values))), lambda w: F.collect_list(F.struct(values)).over(w))
    bare = F.transform(F.col(raw), lambda s: F.struct(s["v"].alias("v")))
    return Summarizer("FitModel", (*xs, response), (one,), ((name, fitted(bare)),))


def _white_noise(x: str, order, seasonal_order, include_mean: bool, name: str) -> Summarizer:
    """``A.fit`` of white noise without its rows.  The id is of the values fitted, in any order, as the estimates are."""
    v = F.col(x).cast("double")
    v = F.when(F.abs(v) < math.inf, v)
    sums = {"n": F.count(v), "square": F.var_pop(v) if include_mean else F.sum(v * v)}
    sums |= {"mean": F.avg(v)} if include_mean else {}
    sums |= {f"id{i}": F.sum(F.when(v.isNotNull(), F.pmod(F.xxhash64(v, F.lit(i)), F.lit(1 << 31)))) for i in (0, 1)}
    outputs = tuple(Output(f"#{n}_{name}", lambda _, c=c: c, lambda w, c=c: c.over(w)) for n, c in sums.items())
    got = {n: F.col(f"`#{n}_{name}`") for n in sums}
    n = F.coalesce(got["n"], F.lit(0))
    square = got["square"] * n if include_mean else got["square"]
    var = F.greatest(F.lit(1e-300), square / F.nullif(n, F.lit(0)))
    k = 1 + bool(include_mean)
    minus = n * F.log(2 * math.pi * var) + square / var  # -2 log likelihood
    told = {
        "coefs": F.array(got["mean"], var) if include_mean else F.array(var),
        "loglik": -0.5 * minus,
        "aic": 2 * k + minus,
        "aicc": 2 * k + minus + F.when(n > k + 1, 2 * k * (k + 1) / (n - k - 1)).otherwise(math.nan),
        "bic": k * F.log(n) + minus,
    }
    ok = (n > 0) & (square < math.inf)
    for c in (got["mean"],) if include_mean else ():
        ok &= F.abs(c) < math.inf
    spec = repr((tuple(order), tuple(seasonal_order), bool(include_mean), x))
    told = {f: F.when(ok, c) for f, c in told.items()} | {
        "order": F.array(*map(F.lit, order)),
        "seasonal_order": F.array(*map(F.lit, seasonal_order)),
        "include_mean": F.lit(bool(include_mean)),
        "names": F.array(*map(F.lit, A.labels(order, seasonal_order, include_mean))),
        "nobs": n,
        "status": F.when(ok, "ok").otherwise("failed"),
        "message": F.when(ok, "").when(n == 0, "no observations").otherwise("the likelihood is not finite"),
        "model_id": F.substring(F.sha2(F.concat_ws("|", F.lit(spec), n, got["id0"], got["id1"]), 256), 1, 16),
    }
    model = F.struct(*[told[f].alias(f) for f in A.FIELDS]).cast(T._parse_datatype_string(A.MODEL_SCHEMA))
    return Summarizer("FitARMA", (x,), outputs, ((name, model),))


def FitARMA(x: str, order=(1, 0, 0), seasonal_order=(0, 0, 0, 0), include_mean: bool = False, name: str = "model") -> Summarizer:
    """A fitted ARMA model of a group's or a window's rows in order, as the operator ``fit_arma`` gives it; missing values are
    gaps, and a failed fit says so in its status.  White noise is told from sums that merge; the rows of one fit of any other
    order are gathered into one cell."""
    A.check(order, seasonal_order)
    if not any(order) and not any(seasonal_order[:3]):
        return _white_noise(x, order, seasonal_order, include_mean, name)
    raw = f"#series_{name}"

    @F.pandas_udf(A.MODEL_SCHEMA)
    def fitted(rows: pd.Series) -> pd.DataFrame:
        out = []
        for group in rows:
            y = np.array([math.nan if v is None else v for v in (group if group is not None else ())], float)
            ident = hashlib.sha256(repr((tuple(order), tuple(seasonal_order), include_mean, x)).encode() + y.tobytes()).hexdigest()[:16]
            out.append(A.fit(y, tuple(order), tuple(seasonal_order), include_mean, model_id=ident))
        return pd.DataFrame(out, columns=A.FIELDS)

    value = F.col(x).cast("double").alias("v")
    one = Output(raw, lambda r: F.array_sort(F.collect_list(F.struct(r.alias("r"), value))), lambda w: F.collect_list(F.struct(value)).over(w))
    return Summarizer("FitARMA", (x,), (one,), ((name, fitted(F.transform(F.col(raw), lambda s: s["v"]))),))


REGISTRY = {f.__name__: f for f in (Count, CountDistinct, Sum, Product, Mean, Min, Max, First, Last, SumPower, Moment, Variance, Std, DotProduct, Correlation, Covariance, LinearRegression, Lags, EMA, FitModel, FitARMA)}
