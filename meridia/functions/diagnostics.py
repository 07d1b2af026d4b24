"""Whole-window diagnostics: Spark computes sufficient statistics, the driver the closing arithmetic.

Missing and non-finite values are dropped and counted.  Regressions on a column's own lags need its sums of lag
products, which are found in blocks of time; no column comes to the driver but for a plot of ``DRIVER_ROWS`` rows at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import arma as A
from meridia.functions.special import adf_critical, adf_p, chi2_tail, normal_quantile
from meridia.functions.summarizers import Count
from meridia.operators import blocks
from meridia.pipeline import TIME, Pipeline
from meridia.span import Span, number


@dataclass
class DiagnosticResult:
    kind: str
    data: dict = field(default_factory=dict)
    summary: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    panels: dict = field(default_factory=dict)


def clean(value: Any) -> Any:
    """JSON values: NaN and infinities become null."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [clean(v) for v in value]
    if isinstance(value, (float, np.floating)):
        return float(value) if math.isfinite(value) else None
    return value.item() if isinstance(value, np.generic) else value


def finite(x: str) -> F.Column:
    c = F.col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def keyed(df: DataFrame, key: str | None) -> DataFrame:
    """``column=value``, matched as text."""
    if not key:
        return df
    column, _, value = key.partition("=")
    if column not in df.columns:
        raise ValueError(f"no such key column: {column}")
    return df.where(F.col(column).cast("string") == value)


#: Rows that may come to the driver for a plot; longer columns are reduced in Spark first.
DRIVER_ROWS = 50_000


def values(p: Pipeline, df: DataFrame, x: str) -> np.ndarray:
    """One column in order, of ``DRIVER_ROWS`` rows at most."""
    rows = df.where(finite(x)).orderBy(*p.sort()).select(F.col(x).cast("double").alias("v")).limit(DRIVER_ROWS + 1)
    v = rows.toArrow().column("v").to_numpy()
    if len(v) > DRIVER_ROWS:
        raise ValueError(f"a column of more than {DRIVER_ROWS} rows doesn't come to the driver")
    return v


def _extent(df: DataFrame) -> Span:
    """The window from a frame's first time to just past its last, for scans in blocks."""
    lo, hi = df.agg(F.min(TIME), F.max(TIME)).first()
    if lo is None:
        return Span(0, 0)
    return Span(lo, hi + (timedelta(microseconds=1) if isinstance(hi, datetime) else timedelta(days=1) if isinstance(hi, date) else 1))


@dataclass
class LagSums:
    """What least squares on a column's own lags needs of it: ``r[d]`` sums z(u) z(u - d), ``w`` sums u z(u), and the first
    and last values."""

    n: int
    mean: float
    total: float
    r: np.ndarray
    w: float
    first: np.ndarray
    last: np.ndarray

    def __post_init__(self):
        k = len(self.r)
        head, tail = self.first, self.last
        self._head = [np.r_[np.zeros(d + 1), np.cumsum(head[d:] * head[: len(head) - d])] if d < len(head) else np.zeros(k + 1) for d in range(k)]
        self._tail = [[float(np.dot(tail[len(tail) - i :], tail[len(tail) - i - d : len(tail) - d])) if i and i + d <= len(tail) else 0.0 for i in range(k)] for d in range(k)]

    def product(self, i: int, j: int, start: int) -> float:
        """Sum of z(t - i) z(t - j) over t >= start."""
        i, j = min(i, j), max(i, j)
        d = j - i
        return float(self.r[d] - self._head[d][max(d, start - i)] - self._tail[d][i])

    def sum(self, i: int, start: int) -> float:
        return self.total - float(self.first[: start - i].sum()) - (float(self.last[-i:].sum()) if i else 0.0)

    def ranked(self, i: int, start: int) -> float:
        """Sum of (t - start + 1) z(t - i) over t >= start."""
        head, tail = np.arange(start - i), np.arange(self.n - i, self.n)
        w = self.w - float(head @ self.first[: start - i]) - (float(tail @ self.last[-i:]) if i else 0.0)
        return w + (i - start + 1) * self.sum(i, start)


def _lagged(p: Pipeline, df: DataFrame, x: str, mean: float, lags: int, span: Span) -> DataFrame:
    """``_z``, the column less its mean, beside its lags ``_l1``..; finite rows only, scanned in blocks of time."""
    order = [o.lstrip("-") for o in p.order]
    z = df.where(finite(x)).withColumn("_z", F.col(x).cast("double") - F.lit(mean)).select(TIME, *[o for o in order if o != TIME], "_z")
    return blocks.lagged(z, "_z", {f"_l{k}": k for k in range(1, lags + 1)}, p, span) if lags else z


def lag_sums(p: Pipeline, df: DataFrame, x: str, lags: int, demean: bool = True, trend: bool = False) -> LagSums:
    rows = df.where(finite(x))
    c = F.col(x).cast("double")
    n, mean, total = rows.agg(F.count(c), F.avg(c), F.sum(c)).first()
    mean, total = (mean or 0.0) if demean else 0.0, total or 0.0
    lags, span = max(0, min(lags, n - 1)), _extent(rows)
    z = _lagged(p, df, x, mean, lags, span)
    got = z.agg(F.sum("_z"), F.sum(F.col("_z") ** 2), *[F.sum(F.col("_z") * F.col(f"_l{k}")) for k in range(1, lags + 1)]).first()
    w = 0.0
    if trend and n:
        at = blocks.running(z.select(TIME, *[o.lstrip("-") for o in p.order], "_z"), [Count()], p, span)
        w = at.agg(F.sum((F.col("count") - 1) * F.col("_z"))).first()[0] or 0.0
    ends = []
    for down in (False, True):
        some = rows.orderBy(*p.sort(descending=down)).limit(lags + 1).select((c - F.lit(mean)).alias("v")).collect()
        ends.append(np.array([r["v"] for r in some], float)[:: -1 if down else 1])
    return LagSums(n, mean, got[0] or 0.0, np.array([v or 0.0 for v in got[1:]]), w, *ends)


def acf_table(p: Pipeline, df: DataFrame, x: str, lags: int = 40, demean: bool = True) -> DataFrame:
    """lag, r, n: lag products from one ordered pass in blocks of time, summed together."""
    if lags < 1:
        raise ValueError("lags must be 1 or more")
    rows = df.where(finite(x))
    mean = (rows.agg(F.avg(F.col(x).cast("double"))).first()[0] or 0.0) if demean else 0.0
    z = _lagged(p, df, x, mean, lags, _extent(rows))
    sums = z.agg(F.count("_z").alias("n"), F.sum(F.col("_z") ** 2).alias("s"), *[F.sum(F.col("_z") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    pairs = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("r")), *[F.struct(F.lit(k).alias("lag"), F.when(F.col("s") > 0, F.col(f"c{k}") / F.col("s")).alias("r")) for k in range(1, lags + 1)])
    return sums.select("n", F.explode(pairs).alias("_p")).select(F.col("_p.lag").alias("lag"), F.col("_p.r").alias("r"), "n").where("lag < n or lag = 0")


def acf(p: Pipeline, df: DataFrame, x: str, lags: int = 40, demean: bool = True, level: float = 0.95) -> DiagnosticResult:
    if not 0 < level < 1:
        raise ValueError("level lies between 0 and 1")
    rows = sorted(acf_table(p, df, x, lags, demean).collect(), key=lambda r: r["lag"])
    n = rows[0]["n"] if rows else 0
    band = normal_quantile((1 + level) / 2) / math.sqrt(n) if n else None
    r = [row["r"] for row in rows]
    warn = ["the series is constant"] if len(r) > 1 and r[1] is None else []
    big = [k for k, v in enumerate(r) if k and v is not None and abs(v) > band]
    dropped = df.count() - n
    return DiagnosticResult("acf", clean({"lags": list(range(len(r))), "acf": r, "band": band}), {"n": n, "dropped": dropped, "significant": big}, warn + spacing(p, df)["warnings"])


def pacf_values(sums: LagSums, lags: int) -> list[float]:
    """The last coefficient of least squares (with intercept) on lags 1..k, from sums of products."""
    out = [1.0]
    for k in range(1, max(0, min(lags, (sums.n - 1) // 2, len(sums.r) - 1)) + 1):
        m = sums.n - k
        gram, xy = np.empty((k + 1, k + 1)), np.empty(k + 1)
        gram[0, 0], xy[0] = m, sums.sum(0, k)
        for i in range(1, k + 1):
            gram[0, i] = gram[i, 0] = sums.sum(i, k)
            xy[i] = sums.product(0, i, k)
            for j in range(i, k + 1):
                gram[i, j] = gram[j, i] = sums.product(i, j, k)
        out.append(float(np.linalg.solve(gram, xy)[-1]) if np.linalg.matrix_rank(gram, hermitian=True) == k + 1 else math.nan)
    return out


def pacf_table(p: Pipeline, df: DataFrame, x: str, lags: int = 40) -> DataFrame:
    """lag, r."""
    r = pacf_values(lag_sums(p, df, x, lags), lags)
    return df.sparkSession.createDataFrame([(k, None if math.isnan(v) else v) for k, v in enumerate(r)], "lag int, r double")


def pacf(p: Pipeline, df: DataFrame, x: str, lags: int = 40, level: float = 0.95) -> DiagnosticResult:
    sums = lag_sums(p, df, x, lags)
    r = pacf_values(sums, lags)
    band = normal_quantile((1 + level) / 2) / math.sqrt(sums.n) if sums.n else None
    return DiagnosticResult("pacf", clean({"lags": list(range(len(r))), "pacf": r, "band": band}), {"n": sums.n, "dropped": df.count() - sums.n})


def ljung_box(p: Pipeline, df: DataFrame, x: str, lags=(10, 20, 40), dof: int = 0, level: float = 0.05) -> DiagnosticResult:
    r = {row["lag"]: row for row in acf_table(p, df, x, max(lags)).collect()}
    n, tests, warn = next(iter(r.values()))["n"] if r else 0, [], []
    for k in lags:
        if k <= dof or k >= n:
            warn.append(f"lag {k} is skipped")
            continue
        q = n * (n + 2) * sum((r[j]["r"] or 0.0) ** 2 / (n - j) for j in range(1, k + 1))
        tests.append({"lag": k, "statistic": q, "dof": k - dof, "pvalue": chi2_tail(q, k - dof)})
    white = all(t["pvalue"] > level for t in tests) if tests else None
    return DiagnosticResult("ljungbox", clean({"tests": tests}), {"n": n, "whitenoise": white}, warn)


def adf(p: Pipeline, df: DataFrame, x: str, deterministic: str = "constant", lag: int | None = None) -> DiagnosticResult:
    """Dickey and Fuller's regression of the change on the level before and ``lag`` changes, from sums of products."""
    if deterministic not in ("none", "constant", "trend"):
        raise ValueError("deterministic is none, constant or trend")
    n = df.where(finite(x)).count()
    if n < 8:
        return DiagnosticResult("adf", {}, {"n": n, "stationary": None}, ["too few rows"])
    k = min(int(12 * (n / 100) ** 0.25) if lag is None else lag, max((n - 4) // 3, 0))
    sums, start, m = lag_sums(p, df, x, k + 1, deterministic != "none", deterministic == "trend"), k + 1, n - 1 - k
    # Level and changes are combinations of z(t), z(t - 1), .., z(t - k - 1).
    levels = np.array([[sums.product(i, j, start) for j in range(k + 2)] for i in range(k + 2)])
    change = np.zeros((k + 2, k + 2))  # rows: the change explained, the level before, the changes before
    change[0, :2], change[1, 1] = (1, -1), 1
    for j in range(1, k + 1):
        change[1 + j, j : j + 2] = 1, -1
    extra = [np.array([sums.sum(i, start) for i in range(k + 2)])] if deterministic != "none" else []
    if deterministic == "trend":
        extra.append(np.array([sums.ranked(i, start) for i in range(k + 2)]))
    size = k + 2 + len(extra)
    gram = np.zeros((size, size))
    gram[: k + 2, : k + 2] = change @ levels @ change.T
    powers = [float(m), m * (m + 1) / 2, m * (m + 1) * (2 * m + 1) / 6]
    for i, e in enumerate(extra):
        gram[k + 2 + i, : k + 2] = gram[: k + 2, k + 2 + i] = change @ e
        for j in range(len(extra)):
            gram[k + 2 + i, k + 2 + j] = powers[i + j]
    X, xy, yy = gram[1:, 1:], gram[1:, 0], gram[0, 0]
    scale = np.sqrt(np.maximum(np.diag(X), 1e-300))
    scaled = X / np.outer(scale, scale)
    if np.linalg.matrix_rank(scaled, tol=1e-11, hermitian=True) < len(X):
        return DiagnosticResult("adf", {}, {"n": n, "stationary": None}, ["the regression is singular"])
    inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
    beta = inverse @ xy
    rss = max(0.0, float(yy - beta @ xy))
    if rss == 0.0:
        return DiagnosticResult("adf", {}, {"n": n, "stationary": None}, ["the regression is singular"])
    stat = float(beta[0] / math.sqrt(rss / (m - len(X)) * inverse[0, 0]))
    pv = adf_p(stat, deterministic)
    return DiagnosticResult("adf", clean({"statistic": stat, "pvalue": pv, "lag": k, "critical": adf_critical(m, deterministic)}), {"n": n, "stationary": pv < 0.05})


def histogram_table(df: DataFrame, x: str, bins: int | None = None) -> DataFrame:
    """bin, count, lo, hi; bins by Freedman-Diaconis (1..200), Sturges where the quartiles meet."""
    rows = df.where(finite(x)).select(F.col(x).cast("double").alias("v"))
    s = rows.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    fd = F.ceil((F.col("hi") - F.col("lo")) / (2 * iqr * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))))
    k = F.lit(bins) if bins else F.greatest(F.lit(1), F.least(F.lit(200), F.when(iqr > 0, fd).otherwise(F.ceil(F.log2(F.col("n"))) + 1)))
    s = s.select("n", "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"), k.cast("int").alias("k"))
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    at = F.least(F.col("k") - 1, F.floor((F.col("v") - F.col("lo")) / step)).cast("int")
    return rows.join(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"), F.first(F.col("lo") + at * step).alias("lo"), F.first(F.col("lo") + (at + 1) * step).alias("hi"))


def histogram(p: Pipeline, df: DataFrame, x: str, bins: int | None = None) -> DiagnosticResult:
    rows = sorted(histogram_table(df, x, bins).collect(), key=lambda r: r["bin"])
    c = F.col(x).cast("double")
    m = df.where(finite(x)).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"), F.percentile(c, F.lit(0.5)).alias("median")).first()
    data = {"bins": [r.asDict() for r in rows]}
    if m["std"] and rows:
        grid = np.linspace(rows[0]["lo"], rows[-1]["hi"], 101)
        data["normal"] = {"x": grid, "y": np.exp(-0.5 * ((grid - m["mean"]) / m["std"]) ** 2) / (m["std"] * math.sqrt(2 * math.pi))}
    return DiagnosticResult("histogram", clean(data), clean(m.asDict()) | {"dropped": df.count() - m["n"]})


def qqplot(p: Pipeline, df: DataFrame, x: str, maxpoints: int = 2000) -> DiagnosticResult:
    """Sample against normal quantiles; of a column beyond ``DRIVER_ROWS``, ``maxpoints`` approximate percentiles."""
    c = F.col(x).cast("double")
    n, mean, std = df.where(finite(x)).agg(F.count(c), F.avg(c), F.stddev_samp(c)).first()
    if n <= DRIVER_ROWS:
        v = np.sort(values(p, df, x))
        q = np.array([normal_quantile((i + 0.5) / n) for i in range(n)])
        keep = lttb(q, v, maxpoints) if n > maxpoints else np.arange(n)
    else:
        at = [(i + 0.5) / maxpoints for i in range(maxpoints)]
        v = np.array(df.where(finite(x)).agg(F.percentile_approx(c, at, 100_000)).first()[0], float)
        q, keep = np.array([normal_quantile(a) for a in at]), np.arange(maxpoints)
    corr = float(np.corrcoef(q, v)[0, 1]) if n > 1 and v.std() > 0 else None
    return DiagnosticResult("qqplot", clean({"theoretical": q[keep], "sample": v[keep]}), clean({"n": n, "correlation": corr, "line": [mean, std if n > 1 else None]}))


def lttb(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Indices that keep a line's shape: in each bucket the point of the largest triangle with the last kept
    point and the next bucket's mean; ends are kept and the first of equals wins."""
    n = len(x)
    if threshold >= n or threshold < 3:
        return np.arange(n)
    every, out, last = (n - 2) / (threshold - 2), [0], 0
    for i in range(threshold - 2):
        a, b = int(i * every) + 1, int((i + 1) * every) + 1
        c, d = b, min(int((i + 2) * every) + 1, n)
        mx, my = x[c:d].mean(), y[c:d].mean()
        area = np.abs((x[last] - mx) * (y[a:b] - y[last]) - (x[last] - x[a:b]) * (my - y[last]))
        last = a + int(np.argmax(area))
        out.append(last)
    return np.array([*out, n - 1])


def _outline(p: Pipeline, rows: DataFrame, maxpoints: int) -> DataFrame:
    """Of each of ``4 * maxpoints`` equal spans of time the least and the greatest value, and the column's ends: all that
    the choice of ``maxpoints`` points looks at."""
    lo, hi = rows.agg(F.min("_t"), F.max("_t")).first()
    bucket = F.floor((F.col("_t") - F.lit(lo)) * F.lit(4 * maxpoints / max(hi - lo, 1e-300)))
    point = F.struct("_t", "v")
    edges = rows.groupBy(bucket.alias("_b")).agg(F.min_by(point, F.struct("v", "_t")).alias("a"), F.max_by(point, F.struct("v", "_t")).alias("b"), F.min_by(point, "_t").alias("c"), F.max_by(point, "_t").alias("d"))
    kept = edges.select(F.explode(F.array("a", "b", "c", "d")).alias("p")).select("p.*").distinct()
    return kept.orderBy("_t", "v")


def series(p: Pipeline, df: DataFrame, *columns: str, key: str | None = None, maxpoints: int = 2000) -> DiagnosticResult:
    df, out, warn = keyed(df, key), {}, []
    kinds = dict(df.dtypes)
    total = df.count()
    for c in columns:
        if kinds[c] in ("string", "boolean") or kinds[c].startswith(("struct", "array")):
            warn.append(f"{c} is not numeric")
            continue
        rows = df.withColumn("_t", number(F.col(TIME), kinds[TIME]).cast("double"))
        if total <= maxpoints:
            got = rows.orderBy(*p.sort()).select("_t", F.col(c).cast("double").alias("v")).toArrow()
            out[c] = {"time": got.column("_t").to_numpy(), "value": got.column("v").to_numpy(zero_copy_only=False)}
        else:
            rows = rows.where(finite(c)).orderBy(*p.sort()).select("_t", F.col(c).cast("double").alias("v"))
            got = (rows if total <= DRIVER_ROWS else _outline(p, rows, maxpoints)).toArrow()
            t, v = got.column("_t").to_numpy(), got.column("v").to_numpy()
            keep = lttb(t, v, maxpoints)
            out[c] = {"time": t[keep], "value": v[keep]}
    return DiagnosticResult("series", clean(out), {"rows": total}, warn)


def summary_table(p: Pipeline, df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: column_name, n, missing (with non-finite), mean, std, min, max, first, last of numeric columns."""
    aggs = []
    for c in columns:
        ok, v = finite(c), F.col(c).cast("double")
        v = F.when(ok, v)
        rank = F.when(ok, p.rank())
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.min_by(v, rank).alias("first"), F.max_by(v, rank).alias("last")))
    return df.agg(F.array(*aggs).alias("_s")).select(F.explode("_s").alias("s")).select("s.*")


def result_summary(p: Pipeline, df: DataFrame, head: int = 5, tail: int = 5, columns: list[str] | None = None, key: str | None = None) -> DiagnosticResult:
    df = keyed(df, key)
    kinds, total, out = dict(df.dtypes), df.count(), {}
    wanted = columns or [c for c in df.columns if not c.startswith(("_", "#"))]
    numeric = [c for c in wanted if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") and c != TIME]
    for r in summary_table(p, df, numeric).collect() if numeric else []:
        out[r["column_name"]] = r.asDict()
    for c in wanted:
        if c not in numeric:
            some = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().limit(33).collect()
            found = sorted(r["v"] for r in some)
            out[c] = {"distinct": found if len(found) <= 32 else None}
    first = [r.asDict() for r in df.select(*wanted).orderBy(*p.sort()).limit(head).collect()]
    rest = max(0, min(tail, total - len(first)))
    last = [r.asDict() for r in df.orderBy(*p.sort(descending=True)).limit(rest).select(*wanted).collect()][::-1]
    return DiagnosticResult("summary", clean({"columns": out, "head": first, "tail": last}), {"rows": total})


def steps_table(df: DataFrame) -> DataFrame:
    """step, count: distances of successive distinct times, found in blocks of time."""
    kind, times = dict(df.dtypes)[TIME], df.select(TIME).distinct()
    at = times.withColumn("_t", number(F.col(TIME), kind).cast("double"))
    lagged = blocks.lagged(at, "_t", {"_was": 1}, Pipeline(lambda _: at), _extent(df))
    return lagged.select((F.col("_t") - F.col("_was")).alias("step")).where("step is not null").groupBy("step").count()


def spacing(p: Pipeline, df: DataFrame) -> dict:
    """Regular, the modal step, and advice when steps differ."""
    found = steps_table(df).orderBy(F.desc("count"), "step").limit(2).collect()
    n = df.count()
    if n < 3 or len(found) < 2 or abs(found[0]["step"] - found[1]["step"]) <= 1e-9 * abs(found[0]["step"]):
        return {"regular": True, "step": found[0]["step"] if found else None, "warnings": []}
    return {"regular": False, "step": found[0]["step"], "warnings": [f"times are irregular; consider intervalize(clock({found[0]['step']:g}), Last)"]}


def fit_report(df: DataFrame, column: str = "model") -> DiagnosticResult:
    if column not in df.columns:
        return DiagnosticResult("fit", {}, {}, [f"there is no column {column}"])
    row = df.where(F.col(column).isNotNull()).agg(F.max_by(column, TIME).alias("m")).first()
    if row["m"] is None:
        return DiagnosticResult("fit", {}, {}, ["there is no model"])
    m = row["m"].asDict(recursive=True)
    coefs = dict(zip(m["names"], m["coefs"])) if m["coefs"] else {}
    return DiagnosticResult("fit", clean({"coefficients": coefs, **{k: m[k] for k in ("loglik", "aic", "aicc", "bic", "nobs")}}), {"status": m["status"]}, [m["message"]] if m["status"] != "ok" else [])


def _filtered(p: Pipeline, df: DataFrame, x: str, system: tuple) -> tuple[np.ndarray, np.ndarray] | None:
    """The filter's state after the last row: one ordered stream in one task, from which only the state comes back."""

    def batches(batches):
        state = None
        for batch in batches:
            v = batch.column("v").to_numpy(zero_copy_only=False).astype(float)
            own = system if state is None else (*system[:5], *state)
            if len(v):
                state = A.kalman(v, *own)[5]
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([list(map(float, state[0]))]), pa.array([list(map(float, state[1].ravel()))])], names=["a", "p"])

    stream = df.coalesce(1).sortWithinPartitions(*p.sort()).select(F.col(x).cast("double").alias("v"))
    got = stream.mapInArrow(batches, "a array<double>, p array<double>").first()
    return None if got is None else (np.array(got["a"]), np.array(got["p"]).reshape(len(got["a"]), -1))


def forecast_fan(p: Pipeline, df: DataFrame, x: str, model: dict | None, h: int = 12, levels=(0.8, 0.95), history: int = 200) -> DiagnosticResult:
    if not model or model.get("status") != "ok":
        return DiagnosticResult("forecast", {}, {}, ["there is no fitted model"])
    kind = dict(df.dtypes)[TIME]
    rows = df.orderBy(*p.sort(descending=True)).limit(history).select(number(F.col(TIME), kind).cast("double").alias("t"), F.col(x).cast("double").alias("v")).collect()[::-1]
    t, v = np.array([r["t"] for r in rows], float), np.array([math.nan if r["v"] is None else r["v"] for r in rows], float)
    system = A.system(model["order"], model["seasonal_order"], model["include_mean"], model["coefs"])
    mean, sd = A.forecast(_filtered(p, df, x, system) or system[5:], *system[:5], h)
    step = spacing(p, df)["step"] or 1.0
    bands = {str(a): {"lower": mean - normal_quantile((1 + a) / 2) * sd, "upper": mean + normal_quantile((1 + a) / 2) * sd} for a in levels}
    future = t[-1] + step * np.arange(1, h + 1) if len(t) else []
    return DiagnosticResult("forecast", clean({"time": future, "mean": mean, "bands": bands, "history": {"time": t, "value": v}}), {"h": h})


def half_summary(df: DataFrame, x: str) -> dict | None:
    """n, dropped, mean, std, min and max of the finite values; None without a row."""
    c, ok = F.col(x).cast("double"), finite(x)
    v = F.when(ok, c)
    got = df.agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).first().asDict()
    rows = got.pop("rows")
    return clean(got | {"dropped": rows - got["n"]}) if rows else None


def residual_panel(p: Pipeline, df: DataFrame, x: str, lags: int = 40, dof: int = 0, fitstop: Any = None, maxpoints: int = 2000) -> DiagnosticResult:
    """Series, fitted values, correlograms and shapes of ``x_residual`` (``x`` may be that column itself); tests and shapes
    use the rows before ``fitstop``, and rows on either side are summarised apart."""
    x = x.removesuffix("_residual")
    r, s = f"{x}_residual", f"{x}_stdresidual"
    if r not in df.columns:
        raise ValueError(f"there is no column {r}")
    shape, warn = s if s in df.columns else r, []
    inside = df if fitstop is None else df.where(F.col(TIME) < fitstop)
    halves = {"insample": half_summary(inside, r), "outofsample": None if fitstop is None else half_summary(df.where(F.col(TIME) >= fitstop), r)}
    if halves["insample"] is None:
        inside = df
        warn.append("no row falls inside the fit window, so every residual is out of sample")
    panels = {
        "series": series(p, df, r, maxpoints=maxpoints), "acf": acf(p, inside, r, lags), "pacf": pacf(p, inside, r, lags),
        "ljungbox": ljung_box(p, inside, r, dof=dof), "histogram": histogram(p, inside, shape), "qqplot": qqplot(p, inside, shape),
    }
    if x in df.columns and f"{x}_fitted" in df.columns:
        panels["fitted"] = series(p, df, x, f"{x}_fitted", maxpoints=maxpoints)
    else:
        warn.append(f"there is no column {x}_fitted beside {r}")
    box = panels["ljungbox"]
    told = {"residual": r, "dof": dof, "fitstop": None if fitstop is None else str(fitstop), "ljungbox": {t["lag"]: t["pvalue"] for t in box.data.get("tests", [])}, "whitenoise": box.summary.get("whitenoise"), "acf_significant": panels["acf"].summary["significant"]}
    warn += [w for panel in panels.values() for w in panel.warnings]
    return DiagnosticResult("residuals", panels=panels, summary=halves | told, warnings=list(dict.fromkeys(warn)))


def column_rows(p: Pipeline, df: DataFrame, *columns: str, key: str | None = None) -> DataFrame:
    """Columns in order as rows, of the rows with the key: any number, as none comes to the driver."""
    return keyed(df, key).orderBy(*p.sort()).select(*dict.fromkeys(columns))


def column_vectors(p: Pipeline, df: DataFrame, *columns: str, key: str | None = None) -> dict[str, list]:
    """:func:`column_rows` as lists for a client; ``DRIVER_ROWS`` rows at most."""
    rows = column_rows(p, df, *columns, key=key)
    got = rows.limit(DRIVER_ROWS + 1).toArrow()
    if got.num_rows > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} rows don't come to the driver")
    return {c: got.column(i).to_pylist() for i, c in enumerate(rows.columns)}


def key_values(df: DataFrame, key: str | list[str], limit: int = 1000) -> list:
    """Distinct values (tuples of several columns), first seen first."""
    by = [key] if isinstance(key, str) else list(key)
    rows = df.groupBy(*by).agg(F.min(TIME).alias("_t")).orderBy("_t", *by).limit(limit).collect()
    return [r[by[0]] if isinstance(key, str) else tuple(r[c] for c in by) for r in rows]


def arma_dof(model: dict | None) -> int:
    if not model:
        return 0
    return model["order"][0] + model["order"][2] + model["seasonal_order"][0] + model["seasonal_order"][2]
