"""Row lags, differences, transforms, exponential averages, autoregression, ARMA and model operators.

Recurrences stream: rows are dealt by key and sorted, and a task carries one state per key across Arrow
batches, so a key with a third of all rows never sits in memory at once.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
from collections.abc import Callable
from dataclasses import replace
from math import comb
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import arma as A
from meridia.functions.summarizers import LinearRegression, Summarizer, ema_label
from meridia.operators import blocks
from meridia.operators.joins import asof_join
from meridia.operators.summarize import summarize, windowed
from meridia.pipeline import TIME, Pipeline, fresh, names
from meridia.span import Span, literal, number, width

Step = Callable[[Pipeline], Pipeline]


def lags(x: str, p: int, key=None, name: str | None = None) -> Step:
    if p < 1:
        raise ValueError("p must be 1 or more")

    def build(pl: Pipeline) -> Pipeline:
        def step(df, span):
            out = {f"{name or f'{x}_lag'}_{i}": i for i in range(1, p + 1)}
            fresh(df, *out)
            if not names(key):
                return blocks.lagged(df, x, out, pl, span)
            return df.withColumns({n: F.lag(x, i).over(pl.window(names(key))) for n, i in out.items()})

        return pl.then(step)

    return build


def difference(x: str, order: int = 1, lag: int = 1, key=None, name: str | None = None) -> Step:
    if order < 1 or lag < 1:
        raise ValueError("order and lag must be 1 or more")
    label = name or (f"{x}_diff" if (order, lag) == (1, 1) else f"{x}_diff_{order}_{lag}")

    def build(pl: Pipeline) -> Pipeline:
        def step(df, span):
            fresh(df, label)
            value = F.col(x)
            if not names(key):
                df = blocks.lagged(df, x, {f"#d{k}": k * lag for k in range(1, order + 1)}, pl, span)
            for k in range(1, order + 1):
                back = F.lag(x, k * lag).over(pl.window(names(key))) if names(key) else F.col(f"#d{k}")
                term = back * comb(order, k)
                value = value - term if k % 2 else value + term
            return df.withColumn(label, value).drop(*[f"#d{k}" for k in range(1, order + 1)])

        return pl.then(step)

    return build


def log_transform(x: str, name: str | None = None, strict: bool = True) -> Step:
    """Natural log: null stays, 0 gives -infinity, a negative value raises (or is null unless ``strict``)."""
    label = name or f"{x}_log"
    bad = F.raise_error(F.lit(f"{x} is negative")).cast("double") if strict else F.lit(None).cast("double")

    def step(df, _):
        fresh(df, label)
        c = F.col(x)
        return df.withColumn(label, F.when(c < 0, bad).when(c == 0, F.lit(float("-inf"))).otherwise(F.log(c)))

    return lambda p: p.then(step)


def box_cox(x: str, lam: float, name: str | None = None, strict: bool = True) -> Step:
    if not math.isfinite(lam):
        raise ValueError("lambda must be finite")
    if lam == 0:
        return log_transform(x, name or f"{x}_boxcox", strict)
    label = name or f"{x}_boxcox"
    bad = F.raise_error(F.lit(f"{x} is negative")).cast("double") if strict else F.lit(None).cast("double")

    def step(df, _):
        fresh(df, label)
        c = F.col(x).cast("double")
        value = (F.pow(c, F.lit(float(lam))) - 1) / F.lit(float(lam))
        return df.withColumn(label, F.when(c < 0, bad).otherwise(value) if lam != int(lam) else value)

    return lambda p: p.then(step)


def _starts(batch: pa.RecordBatch, key: tuple[str, ...]) -> np.ndarray:
    """True where a row's key differs from the row before."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for k in key:
        column = batch.column(k)
        now, was = column.slice(1), column.slice(0, len(column) - 1)
        try:
            differ = pc.not_equal(now, was)
        except pa.ArrowNotImplementedError:  # nested keys
            values = column.to_pylist()
            out[1:] |= [x != y for x, y in zip(values[1:], values)]
            continue
        if pa.types.is_floating(column.type):
            differ = pc.and_not_kleene(differ, pc.and_kleene(pc.is_nan(now), pc.is_nan(was)))
        out[1:] |= pc.fill_null(differ, False).to_numpy(zero_copy_only=False)
        out[1:] |= pc.not_equal(pc.is_null(now), pc.is_null(was)).to_numpy(zero_copy_only=False)
    return out


def _plain(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if pa.types.is_floating(column.type) or pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)


def _streamed(df: DataFrame, key: tuple[str, ...], sort: list, take: tuple[str, ...], outs: list[str], make: Callable[[], Any]) -> DataFrame:
    """``df`` with new double columns: rows by key in order through ``make()``'s ``step({column of take: values}, state)``,
    which gives (columns, state).  All other columns pass as they are, in Arrow."""
    dealt = df.repartition(*[F.col(k) for k in key]) if key else df.coalesce(1)
    dealt = dealt.sortWithinPartitions(*key, *sort)
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outs]])

    def batches(batches):
        step, state, last = make(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, key)
            ends = [[str(batch.column(k)[i].as_py()) if batch.column(k)[i].is_valid else None for k in key] for i in (0, batch.num_rows - 1)]
            new[0], last = ends[0] != last, ends[1]
            values = {c: _plain(batch.column(c)) for c in take}
            out = {o: np.empty(batch.num_rows) for o in outs}
            cuts = np.unique(np.r_[0, np.flatnonzero(new), batch.num_rows]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                columns, state = step({c: x[a:b] for c, x in values.items()}, None if new[a] else state)
                for o in outs:
                    out[o][a:b] = columns[o]
            added = [pa.array(x, mask=np.isnan(x)) for x in out.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return dealt.mapInArrow(batches, schema)


def _ema(values: np.ndarray, alpha: np.ndarray | float, s: float) -> tuple[np.ndarray, float]:
    out = np.empty(len(values))
    each = np.broadcast_to(alpha, len(values)).tolist()
    for i, (v, a) in enumerate(zip(values.tolist(), each)):
        if v == v:
            s = v if s != s else s + a * (v - s)
        out[i] = s
    return out, s


def _in_blocks(pl: Pipeline, df: DataFrame, span: Span, by: tuple[str, ...], take: tuple[str, ...], outs: list[str], make, fold: Callable[[Column, Column], Column], start: Column, carried: str) -> DataFrame:
    """``df`` with the columns ``outs`` of a scan that starts anew in every block of the window (of every key), and
    ``carried``: what the blocks before left behind, ``fold``ed over their last rows.  A block is one task's, whatever the
    window's length and however many rows a key has."""
    rows, keys = blocks.dealt(df, span), ["#b"]
    if by:
        rows, keys = rows.withColumn("#k", F.struct(*by)), ["#k", "#b"]  # equal where keys are null, too
    scan = lambda d: _streamed(d, (*by, "#b"), pl.sort(), take, outs, make)
    ties = [o.lstrip("-") for o in pl.order]
    narrow = rows.select(*keys, TIME, *dict.fromkeys(c for c in (*by, *ties, *take) if c != TIME))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*pl.sort(descending=True)))
    ends = scan(narrow).withColumn("#n", at).where(F.col("#n") == 1).select(*keys, F.struct(*outs).alias("#e"))
    held = F.array_sort(F.collect_list(F.struct("#b", "#e")))  # a row a block
    step = lambda acc, x: F.struct(fold(acc["s"], x["#e"]).alias("s"), F.array_append(acc["l"], F.struct(x["#b"].alias("#b"), acc["s"].alias(carried))).alias("l"))
    nothing = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("#b"), start.alias(carried))), 1, 0)
    folded = F.aggregate(held, F.struct(start.alias("s"), nothing.alias("l")), step)["l"].alias("l")
    carry = ends.groupBy(*keys[:-1]).agg(folded).select(*keys[:-1], F.inline("l"))
    return scan(rows).join(carry if by else F.broadcast(carry), keys).drop(*keys)


def ema(x: str, span: float | None = None, halflife: Any = None, key=None, name: str | None = None, split_keys: bool = False) -> Step:
    """Exponential average; null leaves it unchanged and shows it, null until the first value.

    A key's rows are one task's stream.  Without key, and with ``split_keys`` (for keys that hold a large part of all rows),
    the window is scanned in blocks: after a block's first value the average is p s + q of the state s there, which the
    blocks before decide.
    """
    label = name or ema_label(x, span, halflife)

    def build(pl: Pipeline) -> Pipeline:
        def step(df, window):
            fresh(df, label)
            kind = dict(df.dtypes)[TIME]
            rows = df.withColumns({"#v": F.col(x).cast("double"), "#t": number(F.col(TIME), kind).cast("double")})
            half = None if halflife is None else float(width(halflife, kind))

            def alphas(v, t, seen):
                """Weight of each value, and the time of the last one."""
                if half is None:
                    return 2.0 / (span + 1), seen
                alpha, ok = np.zeros(len(v)), np.flatnonzero(~np.isnan(v))
                if len(ok):
                    alpha[ok] = 1 - np.exp(-math.log(2) * np.diff(np.r_[seen, t[ok]]) / half)
                    seen = t[ok][-1]
                return alpha, seen

            if names(key) and not split_keys:

                def make():
                    def run(part, state):
                        s, seen = state or (math.nan, math.nan)
                        alpha, seen = alphas(part["#v"], part["#t"], seen)
                        out, s = _ema(part["#v"], alpha, s)
                        return {label: out}, (s, seen)

                    return run

                return _streamed(rows, names(key), pl.sort(), ("#v", "#t"), [label], make).drop("#v", "#t")

            def make():
                def run(part, state):
                    v, t = part["#v"], part["#t"]
                    p, q, v1, t1, seen = state or (1.0, 0.0, math.nan, math.nan, math.nan)
                    alpha, last = alphas(v, t, seen)
                    out = np.full((5, len(v)), math.nan)
                    for i, (y, at, a) in enumerate(zip(v.tolist(), t.tolist(), np.broadcast_to(alpha, len(v)).tolist())):
                        if y == y:
                            if v1 != v1:
                                v1, t1 = y, at
                            else:
                                p, q = p * (1 - a), q + a * (y - q)
                            seen = at
                        out[:, i] = p, q, v1, t1, seen
                    return dict(zip(("#p", "#q", "#v1", "#t1", "#t2"), out)), (p, q, v1, t1, last)

                return run

            def after(s, e):
                """The average after a block's row, given the state (s, t) before the block."""
                a = F.lit(2.0 / (span + 1)) if half is None else 1 - F.exp(F.lit(-math.log(2)) * (e["#t1"] - s["t"]) / F.lit(half))
                first = F.when(s["s"].isNull(), e["#v1"]).otherwise(s["s"] + a * (e["#v1"] - s["s"]))
                return F.when(e["#v1"].isNull(), s["s"]).otherwise(e["#p"] * first + e["#q"])

            start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("t"))
            fold = lambda s, e: F.struct(after(s, e).alias("s"), F.coalesce(e["#t2"], s["t"]).alias("t"))
            outs = ["#p", "#q", "#v1", "#t1", "#t2"]
            out = _in_blocks(pl, rows, window, names(key), ("#v", "#t"), outs, make, fold, start, "#c")
            return out.withColumn(label, after(F.col("#c"), {o: F.col(o) for o in outs})).drop("#c", "#v", "#t", *outs)

        return pl.then(step)

    return build


def macd(x: str, fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd", key=None, split_keys: bool = False) -> Step:
    """Fast less slow average, its own average, and their difference.  A key's rows are one task's stream; without key, and
    with ``split_keys``, the window is scanned in blocks, in which all three are linear in the state before."""
    if not 1 <= fast < slow or signal < 1:
        raise ValueError("needs 1 <= fast < slow and signal >= 1")

    def build(pl: Pipeline) -> Pipeline:
        def step(df, window):
            outs = [name, f"{name}_signal", f"{name}_hist"]
            fresh(df, *outs)
            rows = df.withColumn("#v", F.col(x).cast("double"))

            def make():
                def run(part, state):
                    a, b, c = state or (math.nan,) * 3
                    quick, a = _ema(part["#v"], 2 / (fast + 1), a)
                    slowly, b = _ema(part["#v"], 2 / (slow + 1), b)
                    line = quick - slowly
                    sig, c = _ema(line, 2 / (signal + 1), c)
                    return dict(zip(outs, (line, sig, line - sig))), (a, b, c)

                return run

            if names(key) and not split_keys:
                return _streamed(rows, names(key), pl.sort(), ("#v",), outs, make).drop("#v")

            def linear():
                """Per row: the averages f, s, g of a block that starts without a state, and as functions of one."""
                alpha = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)

                def run(part, state):
                    own, by = state or ([math.nan] * 3, [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0])
                    out = np.empty((11, len(part["#v"])))
                    for i, v in enumerate(part["#v"].tolist()):
                        pf, qf, ps, qs, gf, gs, gg, g = by
                        if v == v:
                            own = [v, v, 0.0] if own[0] != own[0] else [own[0] + alpha[0] * (v - own[0]), own[1] + alpha[1] * (v - own[1]), own[2]]
                            pf, qf, ps, qs = pf * (1 - alpha[0]), qf + alpha[0] * (v - qf), ps * (1 - alpha[1]), qs + alpha[1] * (v - qs)
                        k = alpha[2]
                        own[2] += k * (own[0] - own[1] - own[2])
                        by = [pf, qf, ps, qs, gf + k * (pf - gf), gs + k * (-ps - gs), gg * (1 - k), g + k * (qf - qs - g)]
                        out[:, i] = (*own, *by)
                    return dict(zip(parts, out)), (own, by)

                return run

            parts = ["#f", "#s", "#g", "#pf", "#qf", "#ps", "#qs", "#gf", "#gs", "#gg", "#g0"]

            def after(c, e):
                new = c["f"].isNull()
                f, s = F.when(new, e["#f"]).otherwise(e["#pf"] * c["f"] + e["#qf"]), F.when(new, e["#s"]).otherwise(e["#ps"] * c["s"] + e["#qs"])
                return f, s, F.when(new, e["#g"]).otherwise(e["#gf"] * c["f"] + e["#gs"] * c["s"] + e["#gg"] * c["g"] + e["#g0"])

            start = F.struct(*[F.lit(None).cast("double").alias(n) for n in "fsg"])
            fold = lambda c, e: F.struct(*[v.alias(n) for n, v in zip("fsg", after(c, e))])
            out = _in_blocks(pl, rows, window, names(key), ("#v",), parts, linear, fold, start, "#c")
            f, s, g = after(F.col("#c"), {o: F.col(o) for o in parts})
            return out.withColumns({outs[0]: f - s, outs[1]: g, outs[2]: f - s - g}).drop("#c", "#v", *parts)

        return pl.then(step)

    return build


def ar(x: str, p: int, key=None, name: str = "ar") -> Step:
    """Least squares on p row lags, complete rows only: one row per key at the window's stop."""
    cols = [f"{x}_lag_{i}" for i in range(1, p + 1)]
    fit = LinearRegression(*cols, response=x, name=name)
    return lambda pl: pl | lags(x, p, key) | (lambda q: q.then(lambda df, _: df.na.drop(subset=[*cols, x]))) | summarize(fit, key=key)


def _fit_rows(pl: Pipeline, df: DataFrame, x: str, key: tuple[str, ...], name: str, spec: tuple, at) -> DataFrame:
    """One model row per key: a series is what one fit needs, so a group is one key's column."""
    order, seasonal, mean = spec
    A.check(order, seasonal)
    kind = df.schema[x].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{x} is not numeric")
    key_fields = [df.schema[k] for k in key]
    model = T._parse_datatype_string(A.MODEL_SCHEMA)
    schema = T.StructType([*key_fields, T.StructField(name, model)])
    ties = [o for o in pl.order if o.lstrip("-") in df.columns]
    sort, up, when = [o.lstrip("-") for o in ties], [not o.startswith("-") for o in ties], str(at)
    n_key = len(key)

    def fit(k, pdf):
        pdf = pdf.sort_values([TIME, *sort], ascending=[True, *up], kind="stable")
        ident = hashlib.sha256(repr((k, when, spec, x)).encode()).hexdigest()[:16]
        out = A.fit(pdf[x].to_numpy(float, na_value=np.nan), order, seasonal, mean, model_id=ident)
        return pd.DataFrame([[*k[:n_key], out]], columns=[*key, name])

    rows = df.select(TIME, x, *key, *[s for s in sort if s not in (x, *key)])
    groups = rows.groupBy(*key)
    out = groups.applyInPandas(fit, schema)
    return out


def fit_arma(x: str, order=(1, 0, 0), seasonal_order=(0, 0, 0, 0), include_mean: bool = False, name: str = "model", key=None) -> Step:
    spec = (tuple(order), tuple(seasonal_order), bool(include_mean))

    def build(pl: Pipeline) -> Pipeline:
        def step(df, span):
            out = _fit_rows(pl, df, x, names(key), name, spec, span.stop)
            return out.select(literal(span.stop).cast(dict(df.dtypes)[TIME]).alias(TIME), "*")

        return pl.then(step, order=names(key))

    return build


def apply_arma(models: Pipeline, x: str, column: str = "model", key=None, tolerance: Any = None, strict: bool = False, horizon: int = 0, name: str | None = None) -> Step:
    """Filter rows with the latest model as of each row; another model restarts, no model gives nulls."""
    label = name or x
    outs = [f"{label}_fitted", f"{label}_residual", f"{label}_stdresidual", *(f"{label}_forecast_{h}" for h in range(1, horizon + 1))]

    def build(pl: Pipeline) -> Pipeline:
        narrow = models.then(lambda df, _: df.select(TIME, *names(key), F.col(column).alias("#model")))
        joined = pl | asof_join(replace(narrow, order=()), key=key, tolerance=tolerance, strict=strict)

        def step(df, _):
            fresh(df, *outs)
            rows = df.withColumns({"#v": F.col(x).cast("double"), "#m": F.to_json("#model")}).drop("#model")

            def make():
                known: dict[str, A.Filter | None] = {}  # a model's system is built once

                def filter_of(text):
                    if text not in known:
                        model = json.loads(text)
                        known[text] = A.Filter(model, horizon) if model.get("status") == "ok" else None
                    return known[text]

                def run(part, state):
                    table = np.full((len(outs), len(part["#v"])), np.nan)
                    ident, inner = state or (None, None)
                    for i, (v, m) in enumerate(zip(part["#v"].tolist(), part["#m"])):
                        own = filter_of(m) if m is not None else None
                        if own is None:
                            ident, inner = None, None
                            continue
                        if own.model_id != ident:
                            ident, inner = own.model_id, None
                        table[:, i], inner = own.step(v, inner)
                    return dict(zip(outs, table)), (ident, inner)

                return run

            return _streamed(rows, names(key), pl.sort(), ("#v", "#m"), outs, make).drop("#v", "#m")

        return joined.then(step)

    return build


def arma(clock: Pipeline, lookback: Any, x: str, order=(1, 0, 0), seasonal_order=(0, 0, 0, 0), include_mean=False, key=None, horizon: int = 0, name: str | None = None) -> Step:
    """Refit at every tick on ``[tick - lookback, tick)`` and filter from there to the next tick."""
    spec = (tuple(order), tuple(seasonal_order), bool(include_mean))

    def build(pl: Pipeline) -> Pipeline:
        def plan(span):
            rows = windowed(pl.plan(span.widen(before=lookback)), clock, span, lookback)
            out = _fit_rows(pl, rows, x, ("_tick", *names(key)), "model", spec, None)
            return out.withColumnRenamed("_tick", TIME)

        return pl | apply_arma(Pipeline(plan), x, key=key, horizon=horizon, name=name)

    return build


# Model operators.


def fit_input(s: Summarizer) -> Step:
    """Regressions drop incomplete rows before a fit."""
    if s.label in ("LinearRegression", "FitModel"):
        return lambda p: p.then(lambda df, _: df.na.drop(subset=list(s.columns)))
    return lambda p: p


def fit_once(train: Span, s: Summarizer | Step, key=None) -> Step:
    """Fit over ``train`` whatever the run's window; rows at ``train.stop`` show only inside the window."""
    fitting = summarize(s, key=key) if isinstance(s, Summarizer) else s

    def build(p: Pipeline) -> Pipeline:
        prepared = (p | fit_input(s) if isinstance(s, Summarizer) else p) | fitting
        return replace(prepared, plan=lambda span: prepared.plan(train).where(span.where(F.col(TIME))))

    return build


def insample(s: Summarizer, fit_context: Span | None = None, key=None, name: str | None = None) -> Step:
    """Fit over ``fit_context`` (or the window) and apply to every row, before and after: looks ahead."""
    if s.label != "LinearRegression":
        raise TypeError("an in-sample fit takes a LinearRegression; use insample_arma for ARMA")
    response = s.columns[-1]
    betas = [n for n, _ in s.finish if n.endswith("_beta")]
    terms = {b: b.removeprefix(f"{name}_" if name else "").removesuffix("_beta") for b in betas}

    def build(p: Pipeline) -> Pipeline:
        fitted = p | fit_input(s) | summarize(s, key=key)

        def plan(span):
            rows, by = p.plan(span), names(key)
            coef = fitted.plan(fit_context or span).select(*by, *[F.col(b).alias(f"#fit_{b}") for b in betas])
            fresh(rows, f"{response}_fitted", f"{response}_residual")
            if by:
                joined = rows.join(coef, list(by), "left")  # one row per key; AQE broadcasts it when it is small
            else:
                joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(coef.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
            value = F.lit(0.0)
            for b, t in terms.items():
                value = value + (F.col(f"#fit_{b}") if t == "intercept" else F.col(f"#fit_{b}") * F.col(t))
            out = joined.withColumn(f"{response}_fitted", value).withColumn(f"{response}_residual", F.col(response) - F.col(f"{response}_fitted"))
            return out.select(*rows.columns, f"{response}_fitted", f"{response}_residual")

        return replace(p, plan=plan, acausal=True)

    return build


def insample_arma(x: str, order=(1, 0, 0), seasonal_order=(0, 0, 0, 0), include_mean=False, fit_context: Span | None = None, key=None) -> Step:
    fitting = fit_arma(x, order, seasonal_order, include_mean, key=key)

    def build(p: Pipeline) -> Pipeline:
        def models(span):
            df = (p | fitting).plan(fit_context or span)
            return df.withColumn(TIME, literal(span.start).cast(dict(df.dtypes)[TIME]))

        return replace(p | apply_arma(Pipeline(models), x, key=key), acausal=True)

    return build


#: name -> f(column, key, fit_context, **params) giving the steps ``model`` (causal) and ``insample`` (looks ahead).
FAMILIES: dict[str, Callable[..., dict[str, Step]]] = {}


def family(name: str) -> Callable:
    """Register a family of fits of one's own."""

    def add(make: Callable[..., dict[str, Step]]):
        if name in FAMILIES:
            raise ValueError(f"the family {name} exists")
        FAMILIES[name] = make
        return make

    return add


def fit(family: str, column: str | None = None, key=None, fit_context: Span | None = None, **params: Any) -> dict[str, Step]:
    """Two outputs: ``model`` (causal) and ``insample`` (looks ahead)."""
    if family not in FAMILIES:
        raise ValueError(f"family is one of {', '.join(FAMILIES)}")
    steps = FAMILIES[family](column, key, fit_context, **{k: v for k, v in params.items() if v is not None})
    if fit_context is not None:
        steps = steps | {"model": fit_once(fit_context, steps["model"])}
    return steps


@family("arma")
def _arma_family(column, key, fit_context, order=(1, 0, 0), seasonal_order=(0, 0, 0, 0), include_mean=False, **_):
    spec = {"order": order, "seasonal_order": seasonal_order, "include_mean": include_mean}
    return {"model": fit_arma(column, key=key, **spec), "insample": insample_arma(column, fit_context=fit_context, key=key, **spec)}


@family("ar")
def _ar_family(column, key, fit_context, p, **_):
    cols = [f"{column}_lag_{i}" for i in range(1, p + 1)]
    own = insample(LinearRegression(*cols, response=column, name="ar"), fit_context, key, name="ar")
    shown = lambda pl: pl | lags(column, p, key) | own | (lambda q: q.then(lambda df, _: df.drop(*cols)))
    return {"model": ar(column, p, key), "insample": shown}


@family("model")
def _model_family(column, key, fit_context, model, predictors, response, **_):
    made = fit_model(model, predictors, response, key=key)
    return {"model": made, "insample": insample_model(model, predictors, response, fit_context, key)}


def insample_model(model: Any, predictors: list[str], response: str, fit_context: Span | None = None, key=None, operation: str = "predict") -> Step:
    """Fit over ``fit_context`` (or the window) and apply to every row: ``response_fitted`` and ``response_residual``; an
    incomplete row has nulls, and predicted classes have no residual."""
    made = fit_model(model, predictors, response, key=key)
    fitted = f"{response}_fitted"

    def build(pl: Pipeline) -> Pipeline:
        applied = pl | apply_models(_at_start(pl, made, fit_context), predictors, key=key, name=fitted, operation=operation)

        def step(df, _):
            whole = F.col(predictors[0]).isNotNull()
            for c in predictors[1:]:
                whole = whole & F.col(c).isNotNull()
            df = df.withColumn(fitted, F.when(whole, F.col(fitted)))
            return df.withColumn(f"{response}_residual", F.col(response).cast("double") - F.col(fitted))

        return replace(applied.then(step), acausal=True)

    return build


def _at_start(p: Pipeline, fitting: Step, fit_context: Span | None) -> Pipeline:
    def plan(span):
        df = (p | fitting).plan(fit_context or span)
        return df.withColumn(TIME, literal(span.start).cast(dict(df.dtypes)[TIME]))

    return Pipeline(plan)


def fit_model(model: Any, predictors: list[str], response: str, name: str = "model", key=None) -> Step:
    """Fit an object with ``fit(X, y)`` and ``predict(X)`` per key; the model is one binary cell (classes of the driver's script travel with it)."""
    if not hasattr(model, "fit") or not hasattr(model, "predict"):
        raise TypeError("a model has fit and predict")
    blob = cloudpickle.dumps(model)

    def build(pl: Pipeline) -> Pipeline:
        def step(df, span):
            rows, by = df.na.drop(subset=[*predictors, response]).select(*names(key), *predictors, response), names(key)
            schema = T.StructType([*[df.schema[k] for k in names(key)], T.StructField(name, T.BinaryType())])

            def one(k, pdf):
                m = pickle.loads(blob)
                m.fit(pdf[predictors].to_numpy(float), pdf[response].to_numpy(float))
                return pd.DataFrame([[*k[: len(by)], cloudpickle.dumps(m)]], columns=[*by, name])

            out = rows.groupBy(*names(key)).applyInPandas(one, schema)
            return out.select(literal(span.stop).cast(dict(df.dtypes)[TIME]).alias(TIME), "*")

        return pl.then(step, order=names(key))

    return build


def apply_models(models: Pipeline, predictors: list[str], column: str = "model", key=None, tolerance: Any = None, strict: bool = False, name: str = "prediction", operation: str = "predict") -> Step:
    """Predictions of the latest model as of each row."""

    def build(pl: Pipeline) -> Pipeline:
        narrow = models.then(lambda df, _: df.select(TIME, *names(key), F.col(column).alias("#model")))
        joined = pl | asof_join(replace(narrow, order=()), key=key, tolerance=tolerance, strict=strict)

        def step(df, _):
            fresh(df, name)

            @F.pandas_udf("double")
            def predicted(blob: pd.Series, *xs: pd.Series) -> pd.Series:
                x, out = np.column_stack([s.to_numpy(float) for s in xs]), np.full(len(blob), np.nan)
                for b, at in blob.groupby(blob).groups.items():
                    out[at] = getattr(pickle.loads(b), operation)(x[at])
                return pd.Series(out)

            p = predicted("#model", *[F.col(c).cast("double") for c in predictors])
            return df.withColumn(name, F.when(F.col("#model").isNotNull() & ~F.isnan(p), p)).drop("#model")

        return joined.then(step)

    return build


def add_predictions(clock: Pipeline, lookback: Any, model: Any, predictors: list[str], response: str, key=None, name: str = "prediction", operation: str = "predict") -> Step:
    """Refit at every tick on ``[tick - lookback, tick)`` and predict the rows after it."""

    def build(pl: Pipeline) -> Pipeline:
        def plan(span):
            rows = windowed(pl.plan(span.widen(before=lookback)), clock, span, lookback)
            made = fit_model(model, predictors, response, key=("_tick", *names(key)))
            return (Pipeline(lambda _: rows) | made).plan(span).drop(TIME).withColumnRenamed("_tick", TIME)

        return pl | apply_models(Pipeline(plan), predictors, key=key, name=name, operation=operation)

    return build


def model_reports(column: str = "model", name: str = "report") -> Step:
    """A JSON report in place of a model column."""

    def step(df, _):
        if isinstance(df.schema[column].dataType, T.BinaryType):

            @F.pandas_udf("string")
            def report(b: pd.Series) -> pd.Series:
                return b.map(lambda x: None if x is None else repr(vars(pickle.loads(x))))

            return df.withColumn(name, report(column)).drop(column)
        return df.withColumn(name, F.to_json(column)).drop(column)

    return lambda p: p.then(step)


