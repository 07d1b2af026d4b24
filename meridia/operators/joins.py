"""As-of joins by one ordered union, forward as-of, and lookups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators import blocks
from meridia.pipeline import TIME, Pipeline, fresh, names
from meridia.span import number, width

Step = Callable[[Pipeline], Pipeline]


def asof_join(right: Pipeline, key=None, tolerance: Any = None, strict: bool = False, left_prefix: str | None = None, right_prefix: str | None = None, right_time: str | None = None, split_keys: bool = False) -> Step:
    """The latest right row not after (``strict``: before) each left row, not older than ``tolerance``.

    ``split_keys``: scan a key's rows in blocks of time, for keys that hold a large part of all rows.
    """
    return _asof(right, key, tolerance, strict, left_prefix, right_prefix, right_time, split_keys, forward=False)


def future_join(right: Pipeline, key=None, tolerance: Any = None, strict: bool = False, left_prefix: str | None = None, right_prefix: str | None = None, right_time: str | None = None, split_keys: bool = False) -> Step:
    """The earliest right row not before (``strict``: after) each left row."""
    return _asof(right, key, tolerance, strict, left_prefix, right_prefix, right_time, split_keys, forward=True)


def _asof(right, key, tolerance, strict, left_prefix, right_prefix, right_time, split_keys, forward) -> Step:
    by = names(key)

    def build(p: Pipeline) -> Pipeline:
        def plan(span):
            wide = span
            if tolerance is not None:
                wide = span.widen(after=tolerance) if forward else span.widen(before=tolerance)
            left, other = p.plan(span), right.plan(wide)
            kind = dict(left.dtypes)[TIME]
            if left_prefix:
                left = left.withColumnsRenamed({c: f"{left_prefix}_{c}" for c in left.columns if c not in (TIME, *by)})
            fields = [c for c in other.columns if c not in (TIME, "_part", *by)]
            shown = {c: f"{right_prefix}_{c}" if right_prefix else c for c in fields}
            fresh(left, *shown.values(), *([right_time] if right_time else []))
            # Right rows come first at equal times unless strict (and last, looking forward).
            first_right = (not strict) != forward
            side_left, side_right = (1, 0) if first_right else (0, 1)
            order = [F.col(o).alias(f"_o{i}") for i, o in enumerate(o.lstrip("-") for o in right.order if o.lstrip("-") in other.columns)]
            lrows = left.select(TIME, *by, F.lit(side_left).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(other.select(F.struct(TIME, *fields)).schema[0].dataType).alias("_r"), *[F.lit(None).cast(dict(other.dtypes)[o.lstrip("-")]).alias(f"_o{i}") for i, o in enumerate(r for r in right.order if r.lstrip("-") in other.columns)])
            rrows = other.select(TIME, *by, F.lit(side_right).alias("_side"), F.lit(None).cast(lrows.schema["_l"].dataType).alias("_l"), F.struct(TIME, *fields).alias("_r"), *order)
            ties = [F.col(f"_o{i}").desc() if o.startswith("-") else F.col(f"_o{i}").asc() for i, o in enumerate(r for r in right.order if r.lstrip("-") in other.columns)]
            sort = [F.col(TIME), F.col("_side"), *ties]
            if by and not split_keys:
                w = Window.partitionBy(*by).orderBy(*sort)
                seen = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
                both = lrows.unionByName(rrows).withColumn("_m", seen)
            else:
                back = [F.col(f"_o{i}").asc() if o.startswith("-") else F.col(f"_o{i}").desc() for i, o in enumerate(r for r in right.order if r.lstrip("-") in other.columns)]
                both = blocks.last_seen(lrows.unionByName(rrows), F.col("_r"), "_m", sort, [F.col(TIME).desc(), F.col("_side").desc(), *back], wide, forward, by)
            both = both.where(F.col("_l").isNotNull())
            match = F.col("_m")
            if tolerance is not None:
                gap = number(F.col("_m")[TIME], kind) - number(F.col(TIME), kind)
                match = F.when((gap if forward else -gap) <= width(tolerance, kind), F.col("_m"))
            out = both.select(*[F.col("_l")[c].alias(c) for c in left.columns], match.alias("_m"))
            extra = [F.col("_m")[TIME].alias(right_time)] if right_time else []
            return out.select(*left.columns, *extra, *[F.col("_m")[c].alias(n) for c, n in shown.items()])

        order = tuple(o if not left_prefix or o.lstrip("-") in by else (f"-{left_prefix}_{o[1:]}" if o.startswith("-") else f"{left_prefix}_{o}") for o in p.order)
        return replace(p, plan=plan, order=order, acausal=p.acausal or right.acausal or forward)

    return build


def lookup_join(table: DataFrame, key, unmatched: str = "missing", left_prefix: str | None = None, right_prefix: str | None = None, check_unique: bool = True) -> Step:
    """Columns of a table without time, by key; ``unmatched``: missing, drop or error.

    A repeated key fails when the rows are read.  Which side is broadcast, if any, Spark decides by the sizes it finds.
    """
    by = names(key)
    if TIME in table.columns:
        raise ValueError("a lookup table has no time column")
    if unmatched not in ("missing", "drop", "error"):
        raise ValueError("unmatched is missing, drop or error")

    def build(p: Pipeline) -> Pipeline:
        def step(df, _):
            if left_prefix:
                df = df.withColumnsRenamed({c: f"{left_prefix}_{c}" for c in df.columns if c not in (TIME, *by)})
            fields = {c: f"{right_prefix}_{c}" if right_prefix else c for c in table.columns if c not in by}
            fresh(df, *fields.values())
            right = table.withColumnsRenamed(fields)
            if check_unique:
                one = right.groupBy(*by).agg(F.count(F.lit(1)).alias("#n"), F.first(F.struct(*fields.values())).alias("#r"))
                only = F.when(F.col("#n") > 1, F.raise_error(F.lit("the lookup table repeats a key")).cast("boolean")).otherwise(True)
                right = one.where(only).select(*by, *[F.col("#r")[c].alias(c) for c in fields.values()])
            if unmatched == "drop":
                return df.join(right, list(by), "inner").select(*df.columns, *fields.values())
            out = df.join(right.withColumn("_hit", F.lit(True)), list(by), "left")
            if unmatched == "error":
                out = out.withColumn("_hit", F.when(F.col("_hit").isNull(), F.raise_error(F.lit("a key has no row in the lookup table")).cast("boolean")).otherwise(F.col("_hit"))).where("_hit")
            return out.select(*df.columns, *fields.values())

        return p.then(step)

    return build


def lookup_in(entry, key, unmatched: str = "missing", left_prefix: str | None = None, right_prefix: str | None = None) -> Step:
    """:func:`lookup_join` with a session's table."""
    return lookup_join(entry.df, key, unmatched, left_prefix, right_prefix)
