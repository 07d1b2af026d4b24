"""Row and column transforms, and those that move time."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators import blocks
from meridia.pipeline import TIME, Pipeline, fresh, names
from meridia.span import literal, number, shifted, width

Step = Callable[[Pipeline], Pipeline]


def _expr(value: str | Column) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def filter_rows(predicate: str | Column) -> Step:
    return lambda p: p.then(lambda df, _: df.where(_expr(predicate)))


def add_columns(**columns: str | Column) -> Step:
    def step(df: DataFrame, _) -> DataFrame:
        fresh(df, *columns)
        return df.withColumns({k: _expr(v) for k, v in columns.items()})

    return lambda p: p.then(step)


def _matched(df: DataFrame, columns, match) -> list[str]:
    wanted = set(names(columns))
    missing = wanted - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
    test = match if callable(match) else (lambda c: re.search(match, c) is not None) if match is not None else (lambda c: False)
    found = [c for c in df.columns if c != TIME and (c in wanted or test(c))]
    if not found:
        raise ValueError("the selection is empty")
    return found


def select_columns(*columns: str, match=None) -> Step:
    """Named columns and those whose name matches; time and order columns stay."""
    return lambda p: p.then(lambda df, _: df.select(TIME, *dict.fromkeys([*_matched(df, columns, match), *(o.lstrip("-") for o in p.order)])))


def drop_columns(*columns: str, match=None) -> Step:
    def build(p: Pipeline) -> Pipeline:
        def step(df, _):
            gone = set(_matched(df, columns, match)) - {o.lstrip("-") for o in p.order}
            return df.drop(*gone)

        return p.then(step)

    return build


def reorder_columns(*columns: str, match=None) -> Step:
    def step(df, _):
        front = _matched(df, columns, match)
        return df.select(TIME, *front, *[c for c in df.columns if c != TIME and c not in front])

    return lambda p: p.then(step)


def lag(offset: Any) -> Step:
    """Every row later by ``offset``; asks for rows from that much earlier."""
    return _moved(offset, False)


def lead(offset: Any) -> Step:
    """Every row earlier by ``offset``: looks ahead."""
    return _moved(-offset, True)


def _moved(offset: Any, acausal: bool) -> Step:
    def build(p: Pipeline) -> Pipeline:
        def plan(span):
            df = p.plan(span.shift(-offset))
            return df.withColumn(TIME, shifted(F.col(TIME), offset, dict(df.dtypes)[TIME]))

        return replace(p, plan=plan, acausal=p.acausal or acausal)

    return build


def head(n: int) -> Step:
    return lambda p: p.then(lambda df, _: df.orderBy(*p.sort()).limit(n))


def set_time(spec: str | Column) -> Step:
    """New times, none earlier than before; rows that leave the window are dropped."""
    return _set_time(spec, False)


def acausal_set_time(spec: str | Column) -> Step:
    return _set_time(spec, True)


def _set_time(spec: str | Column, acausal: bool) -> Step:
    def build(p: Pipeline) -> Pipeline:
        def step(df, span):
            kind = dict(df.dtypes)[TIME]
            new = _expr(spec).cast(kind)
            if not acausal:
                new = F.when(new < F.col(TIME), F.raise_error(F.lit("a row would move to an earlier time")).cast(kind)).otherwise(new)
            return df.withColumn(TIME, new).where(span.where(F.col(TIME)))

        return p.then(step, acausal=p.acausal or acausal)

    return build


def last_row(key=None) -> Step:
    """The last row (of each key), stamped at the window's stop."""

    def build(p: Pipeline) -> Pipeline:
        def step(df, span):
            by, rest = names(key), [c for c in df.columns if c != TIME and c not in names(key)]
            last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), p.rank()).alias("_last")).where("_last is not null")
            return last.select(literal(span.stop).cast(dict(df.dtypes)[TIME]).alias(TIME), *by, *(F.col(f"_last.{c}").alias(c) for c in rest))

        return p.then(step, order=tuple(dict.fromkeys([*names(key), *p.order])))

    return build


def sort_cycles(*by: str, rev: bool = False) -> Step:
    """Rows of one timestamp in the order of ``by``, stably."""
    return lambda p: replace(p, order=(*(f"-{b}" if rev else b for b in by), *(o for o in p.order if o.lstrip("-") not in by)))


def forward_fill(*columns: str, key=None, tolerance: Any = None, split_keys: bool = False) -> Step:
    """Missing values become the last seen before (of the key), not older than ``tolerance``.

    ``split_keys``: scan a key's rows in blocks of time, for keys that hold a large part of all rows.
    """

    def build(p: Pipeline) -> Pipeline:
        def step(df, span):
            kind, out, all_columns = dict(df.dtypes)[TIME], {}, df.columns
            for c in columns:
                held = F.when(F.col(c).isNotNull(), F.struct(TIME, c))
                if names(key) and not split_keys:
                    seen = F.last(held, ignorenulls=True).over(p.running(names(key)))
                else:
                    df = blocks.last_seen(df, held, f"#seen_{c}", p.sort(), p.sort(descending=True), span, by=names(key))
                    seen = F.col(f"#seen_{c}")
                value = seen[c]
                if tolerance is not None:
                    age = number(F.col(TIME), kind) - number(seen[TIME], kind)
                    value = F.when(age <= width(tolerance, kind), value)
                out[c] = value
            return df.withColumns(out).select(*all_columns)

        return p.then(step)

    return build


def fill_missing(**values: Any) -> Step:
    return lambda p: p.then(lambda df, _: df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dict(df.dtypes)[c])) for c, v in values.items()}))


def page(p: Pipeline, df: DataFrame, offset: int, limit: int) -> DataFrame:
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return df.orderBy(*p.sort()).offset(offset).limit(limit)


