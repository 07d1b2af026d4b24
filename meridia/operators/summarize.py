"""Summarizing transforms: whole window, cycles, running, trailing, tumbling and hopping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.summarizers import Count, Summarizer
from meridia.operators import blocks
from meridia.pipeline import TIME, Pipeline, fresh, names
from meridia.span import literal, number, shifted, width

Step = Callable[[Pipeline], Pipeline]


def _groups(ss: list[Summarizer], rank: Column) -> list[Column]:
    return list({o.name: o.group(rank).alias(o.name) for s in ss for o in s.outputs}.values())


def _finished(df: DataFrame, ss: list[Summarizer]) -> DataFrame:
    for s in ss:
        for name, column in s.finish:
            df = df.withColumn(name, column)
    return df.drop(*[o.name for s in ss if s.finish for o in s.outputs], *[n for s in ss for n, _ in s.finish if n.startswith("#")])


def _emptied(df: DataFrame, ss: list[Summarizer]) -> DataFrame:
    return df.withColumns({o.name: F.coalesce(F.col(o.name), F.lit(o.empty)) for s in ss for o in s.outputs if o.empty is not None})


def _last_rows(df: DataFrame, p: Pipeline, key: tuple[str, ...], n: int, parts: int = 64) -> DataFrame:
    """The last ``n`` rows of each key: of parts of it first, so that a key with very many rows isn't one task's."""
    part = F.pmod(F.xxhash64(TIME, *[o.lstrip("-") for o in p.order]), F.lit(parts))
    for by in ((*key, "#part"), key):
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*p.sort(descending=True)))
        df = df.withColumn("#part", part) if "#part" in by else df
        df = df.withColumn("#at", at).where(F.col("#at") <= n).drop("#at")
    return df.drop("#part")


def declared(keyset: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Declared keys, each once: a given table, broadcast by Catalyst's own size estimate."""
    return keyset.select(*key).distinct()


def summarize(*ss: Summarizer, key=None) -> Step:
    """One row (of each key) at the window's stop; without key, one row even of an empty window."""

    def build(p: Pipeline) -> Pipeline:
        def step(df, span):
            kind = dict(df.dtypes)[TIME]
            deep = [s.params["p"] + 1 for s in ss if s.label == "Lags"]
            if deep and len(deep) == len(ss):
                df = _last_rows(df, p, names(key), max(deep))
            out = df.groupBy(*names(key)).agg(*_groups(ss, p.rank()))
            return _finished(out, ss).select(literal(span.stop).cast(kind).alias(TIME), "*")

        return p.then(step, order=names(key))

    return build


def summarize_cycles(*ss: Summarizer, key=None, keyset: DataFrame | None = None) -> Step:
    """One row per timestamp (and key); ``keyset`` gives a row for every timestamp and declared key."""

    def build(p: Pipeline) -> Pipeline:
        def step(df, _):
            out = df.groupBy(TIME, *names(key)).agg(*_groups(ss, p.rank()))
            if keyset is not None:
                grid = df.select(TIME).distinct().join(declared(keyset, names(key)))
                out = _emptied(grid.join(out, [TIME, *names(key)], "left"), ss)
            return _finished(out, ss)

        return p.then(step, order=names(key))

    return build


def add_summary_columns(*ss: Summarizer, key=None) -> Step:
    """Running summaries, the current row included.  Without key, those that merge run in blocks of time."""

    def build(p: Pipeline) -> Pipeline:
        averages = [s for s in ss if s.label == "EMA"]
        if averages:  # the operator streams; a window would fold its rows anew at every row
            from meridia.operators.timeseries import ema

            rest = [s for s in ss if s.label != "EMA"]
            out = p | add_summary_columns(*rest, key=key) if rest else p
            for s in averages:
                out = out | ema(s.columns[0], key=key, **s.params)
            return out

        def step(df, span):
            if not names(key) and blocks.mergeable(list(ss), p):
                fresh(df, *[o.name for s in ss for o in s.outputs])
                return blocks.running(df, list(ss), p, span)
            w = p.running(names(key))
            out = {}
            for s in ss:
                for i, o in enumerate(s.outputs, 1):
                    out[o.name] = F.lag(s.columns[0], i).over(p.window(names(key))) if s.label == "Lags" else o.over(w)
            fresh(df, *out)
            return _finished(df.withColumns(out), list(ss))

        return p.then(step)

    return build


def add_rolling_columns(windows: dict[str, Any], *ss: Summarizer, key=None, source: Pipeline | None = None) -> Step:
    """Summaries of the trailing closed ``[t - w, t]`` per window name; peers of the timestamp are included.

    ``source``: another stream to summarise; rows of both meet in one ordered pass, without a range join.  Without key
    summaries that merge are put together from pieces of blocks of time, at a cost that doesn't grow with a window's rows; others
    run in blocks at least as long as the longest window, each with the rows of the block before.
    """

    def build(p: Pipeline) -> Pipeline:
        def plan(span):
            longest = max(windows.values())
            wide = span.widen(before=longest)
            if source is None:
                df = p.plan(wide).withColumn("_own", F.lit(True))
            else:
                left = p.plan(span)
                fields = [c for s in ss for c in s.columns]
                right = source.plan(wide).select(TIME, *names(key), *[F.col(c).alias(f"_src_{c}") for c in dict.fromkeys(fields)])
                df = left.withColumn("_own", F.lit(True)).unionByName(right.withColumn("_own", F.lit(False)), allowMissingColumns=True)
            kind = dict(df.dtypes)[TIME]
            df = df.withColumn("_at", number(F.col(TIME), kind))
            quick = not names(key) and blocks.trails(df, list(ss), windows, p, span, source is not None)
            if not names(key) and not quick:
                df = blocks.haloed(df, span, longest)
            out = {}
            for label, w in windows.items():
                frame = Window.partitionBy(*(names(key) or ("#b",))).orderBy("_at").rangeBetween(-width(w, kind), 0)
                for s in ss:
                    for o in s.outputs:
                        out[f"{label}_{o.name}"] = (o, frame)
            fresh(df, *out)
            if source is not None:
                for s in ss:
                    if s.label == "Count":
                        raise ValueError("count a column of the other stream instead")
                kept = {c: F.col(c) for c in df.columns}
                df = df.withColumns({f"_own_{c}": kept[c] for s in ss for c in s.columns if c in kept})
                df = df.withColumns({c: F.col(f"_src_{c}") for s in ss for c in s.columns})
            df = blocks.trailing(df, list(ss), windows, p, span) if quick else df.withColumns({name: o.over(frame) for name, (o, frame) in out.items()})
            if source is not None:
                df = df.withColumns({c: F.col(f"_own_{c}") for s in ss for c in s.columns if f"_own_{c}" in df.columns})
            rows = df.where(F.col("_own")).where(span.where(F.col(TIME)))
            return rows.drop("_own", "_at", "#b", *[c for c in df.columns if c.startswith(("_src_", "_own_"))])

        return replace(p, plan=plan)

    return build


def _regular(clock: Pipeline) -> Any:
    """The spacing of a clock that nothing has changed (None: ticks of any spacing)."""
    return getattr(clock.plan, "every", None)


def _tick(span, k: Column, interval: Any, kind: str) -> Column:
    """The k-th tick of a regular clock, as the source makes it."""
    step = width(interval, kind)
    if kind.startswith("timestamp"):
        return F.timestamp_micros(F.unix_micros(literal(span.start).cast("timestamp")) + k * F.lit(step)).cast(kind)
    if kind == "date":
        return F.date_add(literal(span.start), (k * step).cast("int"))
    return (F.lit(span.start) + k * F.lit(step)).cast(kind)


def _count_to(span, at: Column, interval: Any, kind: str) -> Column:
    """Ticks of a regular clock at or before a time inside the span, those beyond its stop included."""
    step = width(interval, kind)
    if kind.startswith("timestamp") or kind == "date":
        base = number(literal(span.start).cast(kind), kind)
        return F.greatest(F.lit(0).cast("long"), F.floor((number(at, kind) - base) / F.lit(step)).cast("long") + 1)
    k = F.floor((at - F.lit(span.start)) / F.lit(step)).cast("long")  # rounding may be off by one tick
    k = F.when(_tick(span, k, interval, kind) > at, k - 1).when(_tick(span, k + 1, interval, kind) <= at, k + 1).otherwise(k)
    return F.greatest(F.lit(0).cast("long"), k + 1)


def _numbered(clock: Pipeline, span, kind: str) -> DataFrame:
    """(time, #k): ticks of any spacing, numbered from 1 in order."""
    ticks = clock.plan(span).select(TIME).distinct()
    return blocks.running(ticks, [Count()], Pipeline(clock.plan), span).withColumnRenamed("count", "#k")


def _counted(df: DataFrame, ticks: DataFrame, span, out: str) -> DataFrame:
    """``out``: how many ticks come at or before each row, by one ordered pass over both in blocks of time."""
    lrows = df.select(TIME, F.lit(1).alias("#side"), F.struct(*df.columns).alias("#row"), F.lit(None).cast("long").alias("#k"))
    rrows = ticks.select(TIME, F.lit(0).alias("#side"), F.lit(None).cast(lrows.schema["#row"].dataType).alias("#row"), "#k")
    sort = [F.col(TIME), F.col("#side")]
    both = blocks.last_seen(lrows.unionByName(rrows), F.col("#k"), "#n", sort, [F.col(TIME).desc(), F.col("#side").desc()], span)
    return both.where(F.col("#row").isNotNull()).select(*[F.col("#row")[c].alias(c) for c in df.columns], F.coalesce("#n", F.lit(0)).cast("long").alias(out))


def _last_tick(clock: Pipeline, span, kind: str) -> Column:
    """How many ticks a regular clock has in the span, as :func:`meridia.sources.clock` counts them."""
    step = width(_regular(clock), kind)
    extent = span.stop - span.start
    return F.lit(max(0, -int(-(width(extent, kind) if kind.startswith("timestamp") or kind == "date" else extent) // step))).cast("long")


def intervalize(clock: Pipeline, *ss: Summarizer, key=None, keyset: DataFrame | None = None, closelast: bool = False) -> Step:
    """Summaries of ``[tick, next)``, stamped at the closing tick; the last interval only with ``closelast``.

    A regular clock's intervals are arithmetic.  For one of any spacing rows find their interval by one ordered pass over rows
    and ticks in blocks of time: no range join, and no array of ticks beside the rows.
    """

    def build(p: Pipeline) -> Pipeline:
        def plan(span):
            df = p.plan(span)
            kind, every = dict(df.dtypes)[TIME], _regular(clock)
            ticks = None if every is not None else _numbered(clock, span, kind)
            n = _last_tick(clock, span, kind) if every is not None else None
            if every is not None:
                rows = df.withColumn("#n", _count_to(span, F.col(TIME), every, kind)).where(F.col("#n") > 0)
                grid = df.sparkSession.range(1, 2).select(F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("#n")).where(n > 0)
                grid = grid.where((F.col("#n") < n) | F.lit(closelast))
                stamp = F.when(F.col("#n") < n, _tick(span, F.col("#n"), every, kind)).otherwise(literal(span.stop).cast(kind))
                rows = rows.where((F.col("#n") < n) | F.lit(closelast))
            else:
                rows = _counted(df, ticks, span, "#n").where(F.col("#n") > 0)
                grid = ticks.select(F.col("#k").alias("#n"))
                closing = ticks.select((F.col("#k") - 1).alias("#n"), F.col(TIME).alias("#at")).where(F.col("#n") > 0)
                grid = grid.join(closing, "#n", "left" if closelast else "inner")
                stamp = F.coalesce(F.col("#at"), literal(span.stop).cast(kind))
            out = rows.groupBy("#n", *names(key)).agg(*_groups(ss, p.rank()))
            dense = keyset is not None or not names(key)
            if names(key) and dense:
                grid = grid.join(declared(keyset, names(key)))
            if dense or every is None:
                out = grid.join(out, ["#n", *(names(key) if dense else ())], "left" if dense else "inner")
            out = out.withColumn(TIME, stamp)
            out = out.select(TIME, *names(key), *[c for c in out.columns if c not in (TIME, "#n", "#at", *names(key))])
            return _finished(_emptied(out, ss) if dense else out, ss)

        return replace(p, plan=plan, order=names(key), acausal=p.acausal or clock.acausal)

    return build


def windowed(df: DataFrame, clock: Pipeline, span, lookback: Any) -> DataFrame:
    """Each row once for every tick whose ``[tick - lookback, tick)`` holds it, with ``_tick``.

    The ticks of a row are numbers lo..hi, by arithmetic for a regular clock, else by ordered passes over rows and ticks.
    """
    kind, every = dict(df.dtypes)[TIME], _regular(clock)
    if every is not None:
        until = F.least(_count_to(span, shifted(F.col(TIME), lookback, kind), every, kind), _last_tick(clock, span, kind))
        rows = df.withColumns({"#lo": _count_to(span, F.col(TIME), every, kind) + 1, "#hi": until}).where("`#lo` <= `#hi`")
        rows = rows.withColumn("#k", F.explode(F.sequence("#lo", "#hi")))
        return rows.withColumn("_tick", _tick(span, F.col("#k") - 1, every, kind)).drop("#lo", "#hi", "#k")
    ticks = _numbered(clock, span, kind)
    rows = _counted(df, ticks, span, "#lo").withColumn("#was", F.col(TIME)).withColumn(TIME, shifted(F.col(TIME), lookback, kind))
    rows = _counted(rows, ticks, span, "#hi").withColumn(TIME, F.col("#was")).where("`#lo` < `#hi`")
    rows = rows.withColumn("#k", F.explode(F.sequence(F.col("#lo") + 1, F.col("#hi")))).drop("#lo", "#hi", "#was")
    return rows.join(ticks.select("#k", F.col(TIME).alias("_tick")), "#k").drop("#k")


def summarize_windows(clock: Pipeline, lookback: Any, *ss: Summarizer, key=None, keyset: DataFrame | None = None, interval: Any = None) -> Step:
    """Summaries of ``[tick - lookback, tick)`` at each tick; rows are dealt to their ticks by number (see :func:`windowed`)
    and hash-aggregated.  ``interval``: the spacing of a clock that is regular but isn't the source's own."""

    def build(p: Pipeline) -> Pipeline:
        def plan(span):
            own = clock
            if interval is not None and _regular(clock) is None:
                own = replace(clock, plan=lambda s: clock.plan(s))
                own.plan.every = interval
            rows = windowed(p.plan(span.widen(before=lookback)), own, span, lookback)
            out = rows.groupBy("_tick", *names(key)).agg(*_groups(ss, p.rank())).withColumnRenamed("_tick", TIME)
            if keyset is not None or not names(key):
                grid = clock.plan(span).select(TIME).distinct()
                if names(key):
                    grid = grid.join(declared(keyset, names(key)))
                out = _emptied(grid.join(out, [TIME, *names(key)], "left"), ss)
            return _finished(out, ss)

        return replace(p, plan=plan, order=names(key), acausal=p.acausal or clock.acausal)

    return build
