"""Sources, files and table snapshots."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.pipeline import TIME, Pipeline
from meridia.span import Span, literal, time_kind, width

Time = str | Callable[[Span], Column]


def empty_frame(spark: SparkSession, schema: str) -> Pipeline:
    return Pipeline(lambda span: spark.createDataFrame([], schema))


def clock(spark: SparkSession, interval: Any) -> Pipeline:
    """One row per interval from the window's start, before its stop; ranges are dealt to all executors."""

    def plan(span: Span) -> DataFrame:
        kind = time_kind(span.start)
        step = width(interval, kind)
        if step <= 0:
            raise ValueError("a clock's interval must be positive")
        extent = span.stop - span.start
        n = max(0, -int(-(width(extent, kind) if kind in ("timestamp_ntz", "date") else extent) // step))
        ticks = spark.range(n)
        if kind == "timestamp_ntz":
            micros = F.unix_micros(literal(span.start).cast("timestamp")) + F.col("id") * F.lit(step)
            at = F.timestamp_micros(micros).cast("timestamp_ntz")
        elif kind == "date":
            at = F.date_add(literal(span.start), (F.col("id") * step).cast("int"))
        else:
            at = (F.lit(span.start) + F.col("id") * F.lit(step)).cast(kind)
        return ticks.select(at.alias(TIME))

    plan.every = interval  # goes with any change to the clock
    return Pipeline(plan)


def concatenate(*parts: Pipeline) -> Pipeline:
    """Inputs end to end, in connection order; overlapping times are refused when the plan is checked."""
    return _union(parts, merged=False)


def merge(*parts: Pipeline) -> Pipeline:
    """Rows by time, ties in connection order; columns that a part lacks are null."""
    return _union(parts, merged=True)


def _union(parts: tuple[Pipeline, ...], merged: bool) -> Pipeline:
    if not parts:
        raise ValueError("needs one input at least")
    order = tuple(dict.fromkeys(o for p in parts for o in p.order))

    def plan(span: Span) -> DataFrame:
        out = None
        for i, p in enumerate(parts):
            df = p.plan(span)
            df = df.drop("_part").withColumn("_part", F.lit(i))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if not merged and len(parts) > 1:
            ends = out.groupBy("_part").agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
            bad = ends.withColumn("before", F.max("hi").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
            check = bad.agg(F.coalesce(F.max((F.col("before") > F.col("lo")).cast("int")), F.lit(0)).alias("bad"))
            ok = F.when(F.col("bad") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("inputs overlap in time")).cast("boolean"))
            out = out.join(F.broadcast(check.select(ok.alias("_ok"))), F.col("_ok"), "inner").drop("_ok")  # one row
        return out

    return Pipeline(plan, order=("_part", *order), acausal=any(p.acausal for p in parts))


def table(df: DataFrame, time: Time = TIME, order: tuple[str, ...] = (), closed: bool = False, check: bool = False, within: Span | None = None) -> Pipeline:
    """Rows of a DataFrame inside the window (``closed`` keeps rows at its stop).

    ``time``: a column name, renamed to ``time``, or a function of the span.  ``within``: the window that a
    frozen frame was loaded over; a wider one is refused.  ``check`` refuses rows without time.
    """

    def plan(span: Span) -> DataFrame:
        if within is not None and not within.holds(span):
            raise ValueError("the window lies outside of the frame's own")
        rows = df
        if callable(time):
            rows = df.withColumn(TIME, time(span))
        elif time != TIME:
            rows = df.drop(TIME).withColumnRenamed(time, TIME)
        rows = rows.select(TIME, *[c for c in rows.columns if c != TIME])
        if check:
            held = F.when(F.col(TIME).isNull(), F.raise_error(F.lit("a row has no time")).cast(rows.schema[TIME].dataType)).otherwise(F.col(TIME))
            rows = rows.withColumn(TIME, held)
        return rows.where(span.where(F.col(TIME), closed))

    return Pipeline(plan, order=order)


@dataclass(frozen=True)
class Table:
    """A named table of a session: rows, how they are read, and the span that they were loaded over, if frozen."""

    df: DataFrame
    time: str | None = TIME
    order: tuple[str, ...] = ()
    closed: bool = False
    within: Span | None = None


def stored(entry: Table, time: str | None = None, order=None, closed: bool | None = None, check: bool = False) -> Pipeline:
    """The rows of a session's table; a frozen one is read as it was loaded, rows at its stop included."""
    if entry.time is None:
        raise ValueError("the table has no time; look it up by key")
    if entry.within is not None:
        if time or order:
            raise ValueError("a frozen table keeps its time and order")
        return table(entry.df, entry.time, entry.order, True, check, entry.within)
    return table(entry.df, time or entry.time, tuple(order or entry.order), entry.closed if closed is None else closed, check)


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, time: Time = TIME, rename: dict[str, str] | None = None, delim: str | None = None, order=(), closed=False) -> Pipeline:
    """Columns are strings unless ``types`` says otherwise; a .tsv is split at tabs."""
    sep = delim or ("\t" if path.endswith(".tsv") else ",")

    def plan(span: Span) -> DataFrame:
        df = spark.read.option("header", True).option("sep", sep).csv(path)
        df = df.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()}).withColumnsRenamed(rename or {})
        return table(df, time, order, closed).plan(span)

    return Pipeline(plan, order=tuple(order))


def read_parquet(spark: SparkSession, path: str, time: Time = TIME, rename: dict[str, str] | None = None, order=(), closed=False) -> Pipeline:
    return Pipeline(lambda span: table(spark.read.parquet(path).withColumnsRenamed(rename or {}), time, order, closed).plan(span), order=tuple(order))


#: Frames with model columns are Parquet too: models are structs.
read_frame = read_parquet


class Sink:
    """A pass-through in a plan; only :meth:`write` writes."""

    def __init__(self, path: str, kind: str = "parquet", **options: Any):
        self.path, self.kind, self.options = path, kind, options

    def __call__(self, p: Pipeline) -> Pipeline:
        return p

    def write(self, p: Pipeline, span: Span, mode: str = "errorifexists") -> None:
        out = p.plan(span).drop("_part")
        (out.sortWithinPartitions(TIME) if TIME in out.columns else out).write.mode(mode).options(**self.options).format(self.kind).save(self.path)


def write_csv(path: str, **options: Any) -> Sink:
    """With times to the microsecond, as they are read."""
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return Sink(path, "csv", **({"header": True, "timestampNTZFormat": exact, "timestampFormat": exact + "XXX"} | options))


def write_parquet(path: str, **options: Any) -> Sink:
    return Sink(path, "parquet", **options)


write_frame = write_parquet


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (types inferred) or Parquet file; other suffixes and empty files are refused."""
    if path.endswith((".csv", ".tsv", ".txt")):
        df = spark.read.options(header=True, inferSchema=True, sep="\t" if path.endswith(".tsv") else ",").csv(path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError("a table is read from .csv, .tsv, .txt or .parquet")
    if not df.columns or df.isEmpty():
        raise ValueError("the file has no rows")
    return df


SNAPSHOT_TYPES = ("tinyint", "smallint", "int", "bigint", "decimal(20,0)", "float", "double", "boolean", "string", "date", "timestamp_ntz", "timestamp")


def save_table(df: DataFrame, folder: str, name: str, span: Span | None = None) -> str:
    """A Parquet snapshot; the span goes into a one-row table beside it."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is not a table name")
    odd = [c for c, t in df.dtypes if t not in SNAPSHOT_TYPES]
    if odd:
        raise TypeError(f"columns can't be kept in a snapshot: {', '.join(odd)}")
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    meta = json.dumps(None if span is None else [encode_time(span.start), encode_time(span.stop)])
    df.sparkSession.createDataFrame([(meta,)], "span string").coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.span")
    return f"{folder}/{name}.parquet"


def read_snapshot(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, Span | None]:
    meta = json.loads(spark.read.schema("span string").json(f"{folder}/{name}.span").first()["span"])
    return spark.read.parquet(f"{folder}/{name}.parquet"), None if meta is None else Span(*map(decode_time, meta))


def encode_time(value: Any) -> dict:
    if isinstance(value, datetime):
        return {"type": "timestamp", "value": value.isoformat()}
    if isinstance(value, date):
        return {"type": "date", "value": value.isoformat()}
    return {"type": "float" if isinstance(value, float) else "int", "value": value}


def decode_time(data: dict) -> Any:
    kind, value = data["type"], data["value"]
    return {"timestamp": datetime.fromisoformat, "date": date.fromisoformat, "float": float, "int": int}[kind](value)


