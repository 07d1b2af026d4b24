"""Registered queries of files, summarizers, fits, diagnostics, sessions, extensions and streams."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia import graph as G
from meridia import sources as src
from meridia import streaming
from meridia.functions import diagnostics as D
from meridia.functions import summarizers as S
from meridia.operators import summarize, timeseries
from meridia.pipeline import TIME, Pipeline
from meridia.plans import queries as Q
from meridia.session import Session

query, events, rounded, read, MONTH, EV, DAILY, LAGGED = Q.query, Q.events, Q.rounded, Q.read, Q.MONTH, Q.EV, Q.DAILY, Q.LAGGED
DAY = timedelta(days=1)
PLAIN = "select ts time, event_id, user_id, event_type, value from events"


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or a temporary one of a local master."""
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not kept and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{kept.rstrip('/') if kept else 'file://' + tempfile.mkdtemp(prefix='meridia-')}/q-{uuid.uuid4().hex}"


def table_of(spark: SparkSession, data: dict) -> DataFrame:
    """A diagnostic's parallel lists as rows."""
    return spark.createDataFrame(list(zip(*data.values())), list(data))


# Files


@query(PLAIN)
def writecsv_readcsv(spark, d):
    path = scratch(spark)
    src.write_csv(path).write(events(spark, d), MONTH)
    types = {"time": "timestamp_ntz", "event_id": "bigint", "user_id": "bigint", "value": "double"}
    return src.read_csv(spark, path, types).load(MONTH)


@query(PLAIN)
def writeparquet_readparquet(spark, d):
    path = scratch(spark)
    src.write_parquet(path).write(events(spark, d), MONTH)
    return src.read_parquet(spark, path).load(MONTH)


@query("select timestamp '2024-02-01' time, event_type, round(avg(value), 6) mean from events group by 2")
def writejls_readjls(spark, d):
    """Frames with a column of models, written and read again."""
    path = scratch(spark)
    fits = events(spark, d) | timeseries.fit_arma("value", (0, 0, 0), include_mean=True, key="event_type")
    src.write_frame(path).write(fits, MONTH)
    back = src.read_frame(spark, path, closed=True).load(MONTH)
    return back.select(TIME, "event_type", F.round(F.col("model")["coefs"][0], 6).alias("mean"))


@query(PLAIN)
def load_table(spark, d):
    path = f"{scratch(spark)}.parquet"
    events(spark, d).load(MONTH).write.parquet(path)
    return src.table(src.load_table(spark, path)).load(MONTH)


@query("select ts time, event_id, value from events where ts >= '2024-01-05' and ts < '2024-01-20'")
def table_snapshot(spark, d):
    folder = scratch(spark)
    src.save_table(events(spark, d).load(MONTH), folder, "kept", MONTH)
    df, within = src.read_snapshot(spark, folder, "kept")
    return src.table(df, within=within).load(Q.SHORT).select(TIME, "event_id", "value")


# Summarizers

W = "(partition by user_id order by time desc, event_id desc)"


@query(f"with r as (select *, row_number() over {W} n from ({EV})) select timestamp '2024-02-01' time, user_id, max(value) filter (n = 2) value_lag_1, max(value) filter (n = 3) value_lag_2 from r group by user_id")
def lags_summarizer(spark, d):
    return (events(spark, d) | summarize.summarize(S.Lags("value", 2), key="user_id")).load(MONTH)


@query(Q._ema_sql("2.0 / 11") + " select timestamp '2024-02-01' time, user_id, round(arg_max(s, n), 6) value_ema_10 from e group by user_id")
def ema_summarizer(spark, d):
    return rounded((events(spark, d, True) | summarize.summarize(S.EMA("value", span=10), key="user_id")).load(MONTH), value_ema_10=6)


@query("""with recursive r as materialized (select a.event_id, a.ts time, b.value, row_number() over (partition by a.event_id order by b.ts, b.event_id) n from events a join events b on a.user_id = b.user_id and b.ts between a.ts - interval 6 hour and a.ts),
 e(event_id, time, n, s) as (select event_id, time, n, value from r where n = 1 union all select r.event_id, r.time, r.n, e.s + 0.5 * (r.value - e.s) from e join r on r.event_id = e.event_id and r.n = e.n + 1)
 select time, event_id, round(arg_max(s, n), 6) w_value_ema_3 from e group by all""")
def ema_rolling(spark, d):
    p = events(spark, d) | summarize.add_rolling_columns({"w": timedelta(hours=6)}, S.EMA("value", span=3), key="user_id")
    return rounded(p.load(MONTH), w_value_ema_3=6).select(TIME, "event_id", "w_value_ema_3")


@query(Q._ema_sql("2.0 / 11", EV.replace("user_id,", "1 user_id,")) + " select time, event_id, round(s, 6) value_ema_10 from e")
def ema_unkeyed(spark, d):
    return rounded((events(spark, d) | timeseries.ema("value", span=10)).load(MONTH), value_ema_10=6).select(TIME, "event_id", "value_ema_10")


@query(f"select time, event_id, count(*) over w n, case when count(*) over w > 2 then round(regr_slope(value, event_id) over w, 4) + 0.0 end event_id_beta from ({EV}) window w as (partition by user_id order by time, event_id rows unbounded preceding)")
def linear_regression_running(spark, d):
    p = events(spark, d) | summarize.add_summary_columns(S.LinearRegression("event_id", response="value"), key="user_id")
    return p.load(MONTH).select(TIME, "event_id", "n", F.when(F.col("n") > 2, F.round("event_id_beta", 4) + 0.0).alias("event_id_beta"))


@query(f"""with s as (select event_type, count(*) n, avg(value) y, avg(user_id) a, avg(event_id) b, covar_pop(value, user_id) ya, covar_pop(value, event_id) yb, var_pop(user_id) aa, var_pop(event_id) bb, covar_pop(user_id, event_id) ab from ({EV}) group by event_type),
 c as (select *, (ya * bb - yb * ab) / (aa * bb - ab * ab) p, (yb * aa - ya * ab) / (aa * bb - ab * ab) q from s)
 select timestamp '2024-02-01' time, event_type, round(y - p * a - q * b, 3) intercept_beta, round(p, 5) user_id_beta, round(q, 6) event_id_beta, n from c""")
def linear_regression_two(spark, d):
    p = events(spark, d) | summarize.summarize(S.LinearRegression("user_id", "event_id", response="value"), key="event_type")
    return rounded(p.load(MONTH), intercept_beta=3, user_id_beta=5, event_id_beta=6).drop("r2")


def line():
    """Least squares on one predictor, as an object with fit and predict (a local class travels to the executors)."""

    class Line:
        def fit(self, x, y):
            v = x[:, 0] - x[:, 0].mean()
            self.slope = float(v @ (y - y.mean()) / (v @ v)) if v @ v > 0 else 0.0
            self.level = float(y.mean() - self.slope * x[:, 0].mean())

        def predict(self, x):
            return self.level + self.slope * x[:, 0]

    return Line()


def flat():
    class Flat:
        def fit(self, x, y):
            self.mean = round(float(y.mean()), 9)

        def predict(self, x):
            return [self.mean] * len(x)

    return Flat()


FIT_SQL = "with m as (select event_type, regr_intercept(value, event_id) b0, regr_slope(value, event_id) b1 from events where ts >= '2024-01-05' and ts < '2024-01-20' group by 1)"


@query(FIT_SQL + " select ts time, event_id, case when ts >= '2024-01-20' then round(b0 + b1 * event_id, 4) end prediction from events join m using (event_type)")
def applymodels(spark, d):
    e = events(spark, d)
    models = e | timeseries.fit_once(Q.SHORT, timeseries.fit_model(line(), ["event_id"], "value", key="event_type"))
    out = (e | timeseries.apply_models(models, ["event_id"], key="event_type")).load(MONTH)
    return rounded(out, prediction=4).select(TIME, "event_id", "prediction")


@query(f"with t as (select unnest([timestamp '2024-01-01', timestamp '2024-01-11', timestamp '2024-01-21', timestamp '2024-01-31']) tick), m as (select tick, event_type, regr_intercept(value, event_id) b0, regr_slope(value, event_id) b1 from t join ({EV}) on time >= tick - interval 7 day and time < tick group by all) select e.time, e.event_id, round(b0 + b1 * e.event_id, 4) prediction from ({EV}) e asof left join m on e.event_type = m.event_type and e.time >= m.tick")
def addpredictions(spark, d):
    p = events(spark, d) | timeseries.add_predictions(src.clock(spark, timedelta(days=10)), timedelta(days=7), line(), ["event_id"], "value", key="event_type")
    return rounded(p.load(MONTH), prediction=4).select(TIME, "event_id", "prediction")


@query("select timestamp '2024-02-01' time, event_type, '{''mean'': ' || round(avg(value), 9) || '}' report from events group by 2")
def modelreports(spark, d):
    return (events(spark, d) | timeseries.fit_model(flat(), ["event_id"], "value", key="event_type") | timeseries.model_reports()).load(MONTH)


@query("select date_trunc('day', ts) + interval 1 day time, event_type, '{''mean'': ' || round(avg(value), 9) || '}' report from events where ts < '2024-01-31' group by all")
def fitmodel_summarizer(spark, d):
    """A model refitted in every interval."""
    p = events(spark, d) | summarize.intervalize(src.clock(spark, DAY), S.FitModel(flat(), "event_id", "value"), key="event_type")
    return (p | timeseries.model_reports()).load(MONTH)


@query("with t as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 5 day)) tick) select tick time, event_type, count(*)::int nobs, round(avg(value), 5) mean, round(var_pop(value), 3) variance from t join events on ts >= tick - interval 8 day and ts < tick group by all")
def fitarma_summarizer(spark, d):
    """Order (0, 0, 0) with a mean, refitted in every hopping window."""
    p = events(spark, d) | summarize.summarize_windows(src.clock(spark, timedelta(days=5)), timedelta(days=8), S.FitARMA("value", (0, 0, 0), include_mean=True), key="event_type")
    m = F.col("model")
    return p.load(MONTH).select(TIME, "event_type", m["nobs"].alias("nobs"), F.round(m["coefs"][0], 5).alias("mean"), F.round(m["coefs"][1], 3).alias("variance"))


@query(FIT_SQL + " select ts time, event_id, round(b0 + b1 * event_id, 4) value_fitted, round(value - (b0 + b1 * event_id), 4) value_residual from events join m using (event_type)")
def fit_model_insample(spark, d):
    steps = timeseries.fit("model", key="event_type", fit_context=Q.SHORT, model=line(), predictors=["event_id"], response="value")
    return rounded((events(spark, d) | steps["insample"]).load(MONTH), value_fitted=4, value_residual=4).select(TIME, "event_id", "value_fitted", "value_residual")


@query(f"select time, round(avg(total) over (), 4) total_fitted, round(total - avg(total) over (), 4) total_residual from ({DAILY})")
def fit_arma_insample(spark, d):
    steps = timeseries.fit("arma", "total", order=(0, 0, 0), include_mean=True)
    return rounded((Q.daily(spark, d) | steps["insample"]).load(MONTH), total_fitted=4, total_residual=4).select(TIME, "total_fitted", "total_residual")


# Extensions


@query("select timestamp '2024-02-01' time, event_type, round(max(value) - min(value), 6) value_range from events group by 2")
def user_summarizer(spark, d):
    spread = lambda: F.max("value") - F.min("value")
    own = S.Summarizer("Range", ("value",), (S.Output("value_range", lambda _: spread(), lambda w: F.max("value").over(w) - F.min("value").over(w)),))
    return rounded((events(spark, d) | summarize.summarize(own, key="event_type")).load(MONTH), value_range=6)


@query("select ts time, event_id, round(value - avg(value) over (partition by event_type), 6) value_residual from events")
def user_family(spark, d):
    if "level" not in timeseries.FAMILIES:

        @timeseries.family("level")
        def level(column, key, fit_context, **_):
            def centred(p: Pipeline) -> Pipeline:
                def step(df, span):
                    means = (p | summarize.summarize(S.Mean(column), key=key)).plan(fit_context or span).drop(TIME)
                    return df.join(means, key).withColumn(f"{column}_residual", F.col(column) - F.col(f"{column}_mean")).drop(f"{column}_mean")

                return p.then(step, acausal=True)

            return {"model": summarize.summarize(S.Mean(column), key=key), "insample": centred}

    steps = timeseries.fit("level", "value", key="event_type")
    return rounded((events(spark, d) | steps["insample"]).load(MONTH), value_residual=6).select(TIME, "event_id", "value_residual")


def doubled(column: str):
    return lambda p: p.then(lambda df, _: df.withColumn(column, F.col(column) * 2))


@query("select ts time, event_id, round(value * 2, 6) as value from events")
def user_kind(spark, d):
    if "doubled" not in G.REGISTRY:
        G.register(G.Kind("doubled", "own", doubled, (G.IN,), {"column": G.Param("string", G.REQUIRED)}, ("column",)))
    s = _session(spark, d)
    node = s.add_node("doubled", {"column": "value"})
    s.connect(s.add_node("table", {"table": "events"}), node)
    return rounded(s.load(node), value=6).select(TIME, "event_id", "value")


# Sessions


def _session(spark: SparkSession, d: str) -> Session:
    s = Session(spark, MONTH.start, MONTH.stop)
    s.add_table("events", read(spark, d, "events").select("ts", "event_id", "user_id", "event_type", "value"), time="ts", order=("event_id",))
    return s


def _busy_types(s: Session) -> str:
    """A graph: events over 10, then count and mean of each type."""
    nodes = [s.add_node("table", {"table": "events"}), s.add_node("filterrows", {"predicate": "value > 10"})]
    nodes.append(s.add_node("summarize", {"summarizers": [{"summarizer": "Count"}, {"summarizer": "Mean", "columns": ["value"]}], "key": "event_type"}))
    for a, b in zip(nodes, nodes[1:]):
        s.connect(a, b)
    return nodes[-1]


BUSY = "select timestamp '2024-02-01' time, event_type, count(*) count, round(avg(value), 6) value_mean from events where value > 10 group by 2"


@query(BUSY)
def session_graph(spark, d):
    s = _session(spark, d)
    return rounded(s.load(_busy_types(s)), value_mean=6)


@query(BUSY)
def session_run(spark, d):
    s = _session(spark, d)
    node = _busy_types(s)
    return rounded(s.run(node).result()[node, "out"], value_mean=6)


@query(BUSY)
def session_freeze(spark, d):
    s = _session(spark, d)
    return rounded(s.load(s.freeze(_busy_types(s), "busy", scratch(spark))), value_mean=6)


@query(BUSY)
def session_export(spark, d):
    """The exported script, run."""
    s = _session(spark, d)
    scope: dict = {}
    exec(compile(s.export(_busy_types(s)), "export", "exec"), scope)
    return rounded(scope["build"](spark, s.tables), value_mean=6)


@query(BUSY)
def session_persistence(spark, d):
    s, folder = _session(spark, d), scratch(spark)
    node = _busy_types(s)
    s.tables["events"] = src.Table(s.tables["events"].df.drop("user_id"), "ts", ("event_id",))
    s.save(folder)
    other = Session(spark, datetime(2000, 1, 1), datetime(2000, 1, 2))
    other.open(folder)
    return rounded(other.load(node), value_mean=6)


@query("select ts time, event_id, round(value * 2, 6) twice from events")
def session_prelude(spark, d):
    s = _session(spark, d)
    s.set_prelude(["create or replace temporary function twofold(v double) returns double return v * 2"])
    node = s.add_node("addcolumns", {"columns": {"twice": "twofold(value)"}})
    s.connect(s.add_node("table", {"table": "events"}), node)
    return rounded(s.load(node), twice=6).select(TIME, "event_id", "twice")


# Diagnostics


@query(f"with x as (select time, total, lag(total) over (order by time) l from ({DAILY})) select k lag, round(r, 6) r from (select unnest([0, 1]) k, unnest([1.0, regr_slope(total, l)]) r from x where l is not null)")
def pacf(spark, d):
    p = Q.daily(spark, d)
    return D.pacf_table(p, p.load(MONTH), "total", 1).select("lag", F.round("r", 6).alias("r"))


@query(f"with x as (select time, total - (select avg(total) from ({DAILY})) z from ({DAILY})), l as (select z, lag(z, 1) over (order by time) l1, lag(z, 2) over (order by time) l2 from x), r as (select count(*) n, sum(z * l1) / sum(z * z) r1, sum(z * l2) / sum(z * z) r2 from l) select k lag, round(n * (n + 2) * case when k = 1 then r1 * r1 / (n - 1) else r1 * r1 / (n - 1) + r2 * r2 / (n - 2) end, 5) statistic, k::bigint dof from r, (select unnest([1, 2]) k)")
def ljungbox(spark, d):
    p = Q.daily(spark, d)
    tests = D.ljung_box(p, p.load(MONTH), "total", lags=(1, 2)).data["tests"]
    return spark.createDataFrame([(t["lag"], round(t["statistic"], 5), t["dof"]) for t in tests], "lag int, statistic double, dof long")


@query(f"with x as (select total - lag(total) over (order by time) dv, lag(total) over (order by time) l from ({DAILY})), s as (select count(*) m, regr_slope(dv, l) b, regr_sxx(dv, l) sxx, regr_syy(dv, l) syy, regr_sxy(dv, l) sxy from x where l is not null) select round(b / sqrt((syy - b * sxy) / (m - 2) / sxx), 6) statistic, (m + 1) n from s")
def adf(spark, d):
    p = Q.daily(spark, d)
    out = D.adf(p, p.load(MONTH), "total", lag=0)
    return spark.createDataFrame([(round(out.data["statistic"], 6), out.summary["n"])], "statistic double, n long")


@query(f"select count(*) n, round(avg(total), 5) mean, round(stddev_samp(total), 5) std, min(round(total, 4)) least, max(round(total, 4)) most from ({DAILY})")
def qqplot(spark, d):
    p = Q.daily(spark, d)
    out = D.qqplot(p, p.load(MONTH), "total")
    mean, std = out.summary["line"]
    return spark.createDataFrame([(out.summary["n"], round(mean, 5), round(std, 5), round(out.data["sample"][0], 4), round(out.data["sample"][-1], 4))], "n long, mean double, std double, least double, most double")


@query(f"select epoch_us(time)::double as time, round(total, 4) as value from ({DAILY})")
def series(spark, d):
    p = Q.daily(spark, d)
    return table_of(spark, D.series(p, p.load(MONTH), "total").data["total"]).withColumn("value", F.round("value", 4))


@query(f"select count(*) rows, count(*) filter (value = (select max(value) from events)) > 0 has_most, least(2000, count(*))::int points from ({EV})")
def lttb(spark, d):
    """A long series is cut to 2000 points that keep its extremes."""
    p = events(spark, d)
    out = D.series(p, p.load(MONTH), "value", maxpoints=2000)
    got = out.data["value"]
    most = read(spark, d, "events").agg(F.max("value")).first()[0]
    return spark.createDataFrame([(out.summary["rows"], most in got["value"], len(got["time"]))], "rows long, has_most boolean, points int")


@query(f"with last as (select arg_max(total, time) y, max(time) t from ({DAILY})) select h, round(epoch_us(t) + h * 86400000000.0, 0) as time, round(5000 + power(0.6, h) * (y - 5000), 4) mean, round(5000 + power(0.6, h) * (y - 5000) + 1.959963984540054 * sqrt(4 * (1 - power(0.36, h)) / 0.64), 3) upper_95 from last, (select unnest([1, 2, 3]) h)")
def forecast(spark, d):
    """An AR(1) model with a mean, given as a literal, from the last day on."""
    p = Q.daily(spark, d)
    model = Q.MODEL | {"order": [1, 0, 0], "names": ["mean", "ar_L1", "sigma2_η"], "coefs": [5000.0, 0.6, 4.0]}
    out = D.forecast_fan(p, p.load(MONTH), "total", model, h=3).data
    rows_ = [(h, float(t), round(m, 4), round(u, 3)) for h, (t, m, u) in enumerate(zip(out["time"], out["mean"], out["bands"]["0.95"]["upper"]), 1)]
    return spark.createDataFrame(rows_, "h int, time double, mean double, upper_95 double")


@query(f"with g as ({LAGGED}), c as (select event_type, regr_intercept(value, l) b0, regr_slope(value, l) b1 from g where l is not null group by 1), r as (select time < timestamp '2024-01-20' as inside, value - (b0 + b1 * l) e from g join c using (event_type)) select case when inside then 'insample' else 'outofsample' end half, count(e) n, count(*) - count(e) dropped, round(avg(e), 5) mean, round(stddev_samp(e), 5) std from r group by 1")
def residuals(spark, d):
    p = events(spark, d) | timeseries.fit("ar", "value", key="event_type", p=1)["insample"]
    df = p.load(MONTH)
    out = D.residual_panel(p, df, "value", lags=3, fitstop=datetime(2024, 1, 20)).summary
    return spark.createDataFrame([(h, out[h]["n"], out[h]["dropped"], round(out[h]["mean"], 5), round(out[h]["std"], 5)) for h in ("insample", "outofsample")], "half string, n long, dropped long, mean double, std double")


@query("with t as (select distinct epoch_us(ts) t from events), s as (select t - lag(t) over (order by t) step from t) select step::double step, count(*) count from s where step is not null group by 1")
def spacing(spark, d):
    return D.steps_table(events(spark, d).load(MONTH))


@query("select event_type, row_number() over (order by min(ts), event_type) place from events group by 1")
def keyvalues(spark, d):
    found = D.key_values(events(spark, d).load(MONTH), "event_type")
    return spark.createDataFrame([(k, i) for i, k in enumerate(found, 1)], "event_type string, place long")


@query("select event_id, value from events where event_type = 'purchase'")
def columnvectors(spark, d):
    p = events(spark, d)
    return D.column_rows(p, p.load(MONTH), "event_id", "value", key="event_type=purchase")


@query(f"select 'ok' status, round(avg(total), 4) mean, round(2 * 2 + count(*) * (ln(2 * pi() * var_pop(total)) + 1), 4) aic from ({DAILY})")
def fit_report(spark, d):
    out = D.fit_report((Q.daily(spark, d) | timeseries.fit_arma("total", (0, 0, 0), include_mean=True)).load(MONTH))
    return spark.createDataFrame([(out.summary["status"], round(out.data["coefficients"]["mean"], 4), round(out.data["aic"], 4))], "status string, mean double, aic double")


# Streams


def _streamed(spark: SparkSession, d: str, build, mode: str = "append") -> DataFrame:
    """Events read as a stream until all are through, written as Parquet and read again."""
    folder = scratch(spark)
    df = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("time"), "event_id", "user_id", "event_type", "value")
    df.union(df.limit(1).withColumn("time", F.lit("2024-03-01").cast("timestamp"))).write.parquet(f"{folder}/in")  # a late row closes the windows before it
    q = streaming.write_stream(build(streaming.read_stream(spark, f"{folder}/in", df.schema, watermark="0 seconds")), f"{folder}/out", f"{folder}/state", mode)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{folder}/out")


@query("select date_trunc('day', ts) + interval 1 day time, event_type, count(*) count, round(sum(value), 4) value_sum from events group by all")
def streaming_intervalize(spark, d):
    out = _streamed(spark, d, lambda s: streaming.intervalize(s, DAY, S.Count(), S.Sum("value"), key="event_type"))
    return rounded(out.withColumn(TIME, F.col(TIME).cast("timestamp_ntz")), value_sum=4).where(F.col(TIME) < F.lit("2024-02-15").cast("timestamp_ntz"))
