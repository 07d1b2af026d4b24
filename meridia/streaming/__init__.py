"""Structured Streaming forms of the causal operators.

Rows carry ``time`` as an event-time timestamp.  A watermark bounds the state; rows later than it are dropped by
Spark.  Ticks are aligned to the epoch, and a row is stamped with the tick that closes its window, as in the
batch operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridia.functions.summarizers import Summarizer
from meridia.operators.summarize import _finished, _groups
from meridia.pipeline import TIME, names


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, time: str = TIME, watermark: str = "10 minutes", kind: str = "parquet", **options: Any) -> DataFrame:
    """Files as they arrive, with ``time`` as the watermarked event time."""
    df = spark.readStream.schema(schema).format(kind).options(**options).load(path)
    df = df.withColumn(TIME, F.col(time).cast("timestamp"))
    return (df if time == TIME else df.drop(time)).withWatermark(TIME, watermark)


def _text(offset: timedelta) -> str:
    return f"{offset // timedelta(microseconds=1)} microseconds"


def _windowed(df: DataFrame, window: Any, ss: tuple[Summarizer, ...], key) -> DataFrame:
    clash = [s.label for s in ss if s.label in ("Lags", "EMA")]
    if clash:
        raise ValueError(f"state over windows of a stream isn't kept for {', '.join(clash)}")
    out = _finished(df.groupBy(window.alias("_w"), *names(key)).agg(*_groups(list(ss), F.struct(TIME))), list(ss))
    return out.select(F.col("_w")["end"].alias(TIME), *[c for c in out.columns if c != "_w"])


def intervalize(df: DataFrame, interval: timedelta, *ss: Summarizer, key=None) -> DataFrame:
    """Tumbling windows ``[tick, tick + interval)``."""
    return _windowed(df, F.window(TIME, _text(interval)), ss, key)


def summarize_windows(df: DataFrame, interval: timedelta, lookback: timedelta, *ss: Summarizer, key=None) -> DataFrame:
    """Trailing windows ``[tick - lookback, tick)`` at every tick."""
    return _windowed(df, F.window(TIME, _text(lookback), _text(interval)), ss, key)


def sessions(df: DataFrame, gap: timedelta, *ss: Summarizer, key=None) -> DataFrame:
    """Windows that a gap closes, stamped at the last row's time plus the gap."""
    return _windowed(df, F.session_window(TIME, _text(gap)), ss, key)


def ema(df: DataFrame, x: str, span: float, key, name: str | None = None) -> DataFrame:
    """The running average of each key, its state kept from batch to batch; rows of a batch go in time order."""
    label, by, alpha = name or f"{x}_ema_{span}", names(key), 2.0 / (span + 1)
    if not by:
        raise ValueError("a running average of a stream needs a key")
    fields = [*df.schema.fields, T.StructField(label, T.DoubleType())]

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(TIME, kind="stable")
        s = state.get[0] if state.exists else math.nan
        out = np.empty(len(rows))
        for i, v in enumerate(rows[x].to_numpy(float)):
            if v == v:
                s = v if s != s else s + alpha * (v - s)
            out[i] = s
        state.update((s,))
        yield rows.assign(**{label: np.where(np.isnan(out), None, out)})

    return df.groupBy(*by).applyInPandasWithState(update, T.StructType(fields), "value double", "append", GroupStateTimeout.NoTimeout)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", step: Callable[[DataFrame], DataFrame] | None = None, **options: Any):
    """Start a query to Parquet.  ``step``, if given, is a batch operator applied to each micro-batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    if step is None:
        return writer.format("parquet").option("path", path).start()

    def each(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch run again replaces itself

    return writer.foreachBatch(each).start()
