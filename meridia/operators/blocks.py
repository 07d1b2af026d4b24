"""Running windows without a key, in blocks of time.

A window without partition keys would send every row to one task.  Here the evaluation window is cut into ``BLOCKS``
or more equal blocks of time, each block is scanned by itself, and what it needs from the blocks before it comes from a
table of one row per block, which is broadcast (its size depends on their number, not on the data).  Rows outside the
window, moved there by an operator, join the first or the last block.  Rows that crowd into a small part of the
window share fewer blocks.
"""

from __future__ import annotations

import math
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.summarizers import Summarizer
from meridia.pipeline import TIME, Pipeline
from meridia.span import Span, number, width

BLOCKS, MOST = 1024, 8192


def count_of(df: DataFrame) -> int:
    """Blocks of a window: more on a session with more shuffle partitions, as it expects more data."""
    return max(BLOCKS, min(MOST, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


BEFORE = (Window.unboundedPreceding, -1)
#: How a running value goes on from the value of all blocks before.
MERGES = {"Count": "add", "Sum": "add", "SumPower": "add", "DotProduct": "add", "Product": "times", "Min": "least", "Max": "greatest", "First": "first", "Last": "last"}


def _edge(value: Any) -> float:
    if isinstance(value, datetime):
        return (value.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1e6
    if isinstance(value, date):
        return float((value - date(1970, 1, 1)).days)
    return float(value)


def dealt(df: DataFrame, span: Span) -> DataFrame:
    lo, hi = _edge(span.start), _edge(span.stop)
    if not (math.isfinite(lo) and math.isfinite(hi) and hi > lo):
        return df.withColumn("#b", F.lit(0).cast("long"))
    n = count_of(df)
    at = F.floor((number(F.col(TIME), dict(df.dtypes)[TIME]).cast("double") - lo) * (n / (hi - lo)))
    return df.withColumn("#b", F.coalesce(F.greatest(F.least(at, F.lit(n)), F.lit(-1)), F.lit(-1)).cast("long"))


def haloed(df: DataFrame, span: Span, back: Any) -> DataFrame:
    """Rows (with ``_own``) by blocks ``#b`` no shorter than ``back``; a row is there once more, not its own, in the block after."""
    lo, hi = _edge(span.start), _edge(span.stop)
    reach = float(width(back, dict(df.dtypes)[TIME]))
    if not (math.isfinite(lo) and math.isfinite(hi) and hi > lo and reach >= 0):
        return df.withColumn("#b", F.lit(0).cast("long"))
    n = max(1, min(count_of(df), int((hi - lo) / reach))) if reach > 0 else count_of(df)
    at = F.greatest(F.least(F.floor((F.col("_at").cast("double") - F.lit(lo)) * F.lit(n / (hi - lo))), F.lit(n - 1)), F.lit(-1)).cast("long")
    rows = df.withColumn("#b", F.explode(F.array(at, at + 1)))
    return rows.withColumn("_own", F.col("_own") & (F.col("#b") == at))


def _grid(df: DataFrame, per_block: DataFrame) -> DataFrame:
    """Every block, with its row if it has one."""
    return df.sparkSession.range(-1, count_of(df) + 1).select(F.col("id").alias("#b")).join(per_block, "#b", "left")


def last_seen(df: DataFrame, value: Column, out: str, sort: list[Column], reverse: list[Column], span: Span, forward: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The last value (a struct) not null at or before each row; ``forward``: the first at or after it.

    ``by``: of each key, whose rows are scanned in blocks too, so that a key with very many rows is many tasks'.
    """
    df = dealt(df, span).withColumn("#v", value)
    keys = ["#b"]
    if by:
        df, keys = df.withColumn("#k", F.struct(*by)), ["#k", "#b"]  # equal where keys are null, too
    w = Window.partitionBy(*keys).orderBy(*sort)
    own = F.first("#v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("#v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.row_number().over(Window.partitionBy(*keys).orderBy(*(sort if forward else reverse)))
    ends = df.where(F.col("#v").isNotNull()).withColumn("#n", end).where(F.col("#n") == 1).select(*keys, F.col("#v").alias("#c"))
    present = df.select(*keys).distinct().join(ends, keys, "left") if by else _grid(df, ends)
    across = (Window.partitionBy("#k") if by else Window).orderBy("#b")
    carry = F.first("#c", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("#c", ignorenulls=True).over(across.rowsBetween(*BEFORE))
    carried = present.select(*keys, carry.alias("#c"))
    joined = df.join(carried if by else F.broadcast(carried), keys)
    return joined.withColumn(out, F.coalesce(own, F.col("#c"))).drop(*keys, "#v", "#c")


def lagged(df: DataFrame, x: str, offsets: dict[str, int], p: Pipeline, span: Span) -> DataFrame:
    """Row lags: the first rows of a block reach into a list of the last values before it."""
    deep = max(offsets.values())
    df = dealt(df, span)
    back = Window.partitionBy("#b").orderBy(*p.sort(descending=True))
    ends = df.select("#b", F.struct(F.col(x).alias("v")).alias("#e"), F.row_number().over(back).alias("#n")).where(F.col("#n") <= deep)
    lists = ends.groupBy("#b").agg(F.array_sort(F.collect_list(F.struct("#n", "#e"))).alias("#l"))
    before = F.collect_list("#l").over(Window.orderBy(F.col("#b").desc()).rowsBetween(1, Window.unboundedFollowing))
    carried = _grid(df, lists).select("#b", F.slice(F.flatten(before), 1, deep).alias("#c"))
    w = Window.partitionBy("#b").orderBy(*p.sort())
    df = df.join(F.broadcast(carried), "#b").withColumn("#n", F.row_number().over(w))
    out = {}
    for name, i in offsets.items():
        out[name] = F.when(F.col("#n") > i, F.lag(x, i).over(w)).otherwise(F.get(F.col("#c"), F.lit(i) - F.col("#n"))["#e"]["v"])
    return df.withColumns(out).drop("#b", "#c", "#n")


def mergeable(ss: list[Summarizer], p: Pipeline) -> bool:
    return all(s.label in MERGES or s.label == "Mean" for s in ss) and not any(o.startswith("-") for o in p.order)


def running(df: DataFrame, ss: list[Summarizer], p: Pipeline, span: Span) -> DataFrame:
    """Running summaries whose value over two pieces follows from the pieces' values."""
    shown = [*df.columns, *dict.fromkeys(s.outputs[0].name for s in ss)]
    df = dealt(df, span)
    w = Window.partitionBy("#b").orderBy(*p.sort()).rowsBetween(Window.unboundedPreceding, 0)
    parts: dict[str, tuple[Column, Column, str]] = {}
    final: dict[str, Column] = {}
    for s in ss:
        o = s.outputs[0]
        if s.label == "Mean":
            x = F.col(s.columns[0]).cast("double")
            parts[f"#s_{o.name}"] = (F.sum(x), F.sum(x).over(w), "add")
            parts[f"#k_{o.name}"] = (F.count(x), F.count(x).over(w), "add")
            final[o.name] = F.when(F.col(f"#k_{o.name}") > 0, F.col(f"#s_{o.name}") / F.col(f"#k_{o.name}"))
        else:
            group, over = o.group(p.rank()), o.over(w)
            if s.label in ("First", "Last"):  # the first row's value may be null
                group, over = F.when(F.count(F.lit(1)) > 0, F.struct(group.alias("v"))), F.struct(over.alias("v"))
            parts[o.name] = (group, over, MERGES[s.label])
            if s.label in ("First", "Last"):
                final[o.name] = F.col(o.name)["v"]
    per_block = df.groupBy("#b").agg(*[g.alias(f"#c_{n}") for n, (g, _, _) in parts.items()])
    across = Window.orderBy("#b").rowsBetween(*BEFORE)
    fold = {"add": F.sum, "times": F.product, "least": F.min, "greatest": F.max, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}
    carried = _grid(df, per_block).select("#b", *[fold[m](F.col(f"#c_{n}")).over(across).alias(f"#c_{n}") for n, (_, _, m) in parts.items()])
    df = df.join(F.broadcast(carried), "#b")
    merged = {}
    for n, (_, over, m) in parts.items():
        c = F.col(f"#c_{n}")
        merged[n] = {
            "add": lambda: F.coalesce(over + c, over, c), "times": lambda: F.coalesce(over * c, over, c), "least": lambda: F.least(over, c),
            "greatest": lambda: F.greatest(over, c), "first": lambda: F.coalesce(c, over), "last": lambda: over,
        }[m]().cast(per_block.schema[f"#c_{n}"].dataType)
    return df.withColumns(merged).withColumns(final).select(*shown)


def trails(df: DataFrame, ss: list[Summarizer], windows: dict[str, Any], p: Pipeline, span: Span, foreign: bool) -> bool:
    """Whether :func:`trailing` can give these: summaries that merge, and times that are whole numbers."""
    kinds = dict(df.dtypes)
    kind = kinds[TIME]
    if not (kind.startswith("timestamp") or kind in ("date", "bigint", "int", "smallint", "tinyint")):
        return False
    lo, hi = _edge(span.start), _edge(span.stop)
    if not (math.isfinite(lo) and math.isfinite(hi) and hi > lo and lo == int(lo) and hi == int(hi)):
        return False
    if any(width(w, kind) != int(width(w, kind)) or width(w, kind) <= 0 for w in windows.values()):
        return False
    if foreign and any(s.label in ("First", "Last") for s in ss):
        return False
    return mergeable(ss, p) and not any(s.label == "Mean" and kinds.get(s.columns[0], "").startswith("decimal") for s in ss)


def _within(df: DataFrame, span: Span, longest: int) -> DataFrame:
    """Rows that a row of the window may look back to."""
    return df.where((F.col("_at") >= F.lit(int(_edge(span.start)) - longest)) & (F.col("_at") < F.lit(int(_edge(span.stop)))))


def trailing(df: DataFrame, ss: list[Summarizer], windows: dict[str, Any], p: Pipeline, span: Span) -> DataFrame:
    """Summaries of ``[t - w, t]`` whose cost doesn't grow with the rows of a window.

    Blocks of time of equal length, ``m`` or so to the window: a row's window is the end of the block that holds ``t - w``,
    the blocks between, and the beginning of the row's own block.  The beginnings are running summaries; the ends are running
    summaries backwards, where each row asks at ``t - w``; the blocks between come from a table of one row per block (none, where
    blocks are as long as the window).
    """
    kind = dict(df.dtypes)[TIME]
    lo, extent = int(_edge(span.start)), int(_edge(span.stop)) - int(_edge(span.start))
    sizes = {label: int(width(w, kind)) for label, w in windows.items()}
    df = _within(df, span, max(sizes.values()))
    folds = {"add": F.sum, "times": F.product, "least": F.min, "greatest": F.max, "first": lambda c: F.min_by(c, c["r"]), "last": lambda c: F.max_by(c, c["r"])}
    merges = {
        "add": lambda a, b: F.coalesce(a + b, a, b), "times": lambda a, b: F.coalesce(a * b, a, b), "least": F.least, "greatest": F.greatest,
        "first": F.coalesce, "last": lambda a, b: F.coalesce(b, a),
    }
    parts: dict[str, tuple[Column, str]] = {}  # of rows whose values are there: not of those that only ask
    final: dict[str, Column] = {}
    for s in ss:
        o = s.outputs[0]
        if s.label == "Count":
            parts[o.name] = (F.count("#one"), "add")
            final[o.name] = F.coalesce(F.col(f"#p_{o.name}"), F.lit(0).cast("long"))
        elif s.label == "Mean":
            x = F.col(s.columns[0]).cast("double")
            parts[f"s_{o.name}"], parts[f"k_{o.name}"] = (F.sum(x), "add"), (F.count(x), "add")
            final[o.name] = F.when(F.col(f"#p_k_{o.name}") > 0, F.col(f"#p_s_{o.name}") / F.col(f"#p_k_{o.name}"))
        elif s.label in ("First", "Last"):
            c = F.when(F.col("#one").isNotNull(), F.struct(p.rank().alias("r"), F.col(s.columns[0]).alias("v")))
            parts[o.name] = (folds[MERGES[s.label]](c), MERGES[s.label])
            final[o.name] = F.col(f"#p_{o.name}")["v"]
        else:
            parts[o.name] = (o.group(F.lit(None)), MERGES[s.label])
            final[o.name] = F.col(f"#p_{o.name}")
    fields = {c for s in ss for c in s.columns} | ({TIME, *p.order} if any(s.label in ("First", "Last") for s in ss) else set())
    merged = lambda way, *cs: cs[0] if len(cs) == 1 else merges[way](cs[0], merged(way, *cs[1:]))
    for label, w in sizes.items():
        shown = df.columns
        unit = w // min(w, max(1, -(-count_of(df) * w // (extent + w))))
        m = w // unit
        block = lambda at: F.expr(f"cast({at} - {lo} - pmod({at} - {lo}, {unit}) as bigint) div {unit}")
        df = df.withColumn("#one", F.lit(1)).withColumn("#b", block("_at"))
        until = Window.partitionBy("#b").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        types = {n: f.dataType for n, f in zip(parts, df.select(*[a.alias(n) for n, (a, _) in parts.items()]).schema)}
        begun = df.withColumns({f"#a_{n}": a.over(until) for n, (a, _) in parts.items()})
        asks = F.array(
            F.struct(F.lit(False).alias("ask"), F.col("#b").alias("b"), F.col("_at").alias("at")),
            F.struct(F.lit(True).alias("ask"), block(f"(_at - {w})").alias("b"), (F.col("_at") - F.lit(w)).alias("at")),
        )
        both = begun.select("*", F.explode(asks).alias("#q"))
        ask = F.col("#q")["ask"]
        kept = [*shown, "#b", *[f"#a_{n}" for n in parts]]
        both = both.select(
            F.col("#q")["b"].alias("#i"), F.col("#q")["at"].alias("#at"), F.when(ask, F.struct(*kept)).alias("#row"),
            F.when(~ask, F.col("#one")).alias("#one"), *[F.when(~ask, F.col(c)).alias(c) for c in sorted(fields)],
        )
        since = Window.partitionBy("#i").orderBy(F.col("#at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumns({f"#c_{n}": a.over(since) for n, (a, _) in parts.items()}).where(F.col("#row").isNotNull())
        joined = both.select("#i", *[f"#c_{n}" for n in parts], "#row.*")
        if m > 1 or w % unit:
            table = df.groupBy("#b").agg(*[a.alias(f"#t_{n}") for n, (a, _) in parts.items()])
            between = None
            for back in {m - 1, m} if w % unit else {m - 1}:
                over = Window.orderBy("#b").rangeBetween(-back, -1)
                one = table.select("#b", (F.col("#b") - F.lit(back + 1)).alias("#i"), *[folds[way](F.col(f"#t_{n}")).over(over).alias(f"#m_{n}") for n, (_, way) in parts.items()])
                between = one if between is None else between.unionByName(one)
            joined = joined.join(F.broadcast(between), ["#b", "#i"], "left")
        pieces = ("c", "m", "a") if m > 1 or w % unit else ("c", "a")
        joined = joined.withColumns({f"#p_{n}": merged(way, *[F.col(f"#{k}_{n}") for k in pieces]).cast(types[n]) for n, (_, way) in parts.items()})
        df = joined.select(*shown, *[c.alias(f"{label}_{n}") for n, c in final.items()])
    return df
