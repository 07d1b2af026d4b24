"""Registered queries of the time-series engine over the driver's tables, with their DuckDB SQL.

Doubles that sum in an engine's own order are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia import sources as src
from meridia.functions import summarizers as S
from meridia.operators import joins, rows, summarize, timeseries
from meridia.pipeline import TIME, Pipeline
from meridia.span import Span

MONTH = Span(datetime(2024, 1, 1), datetime(2024, 2, 1))
SHORT = Span(datetime(2024, 1, 5), datetime(2024, 1, 20))
YEARS = Span(datetime(1990, 1, 1), datetime(2010, 1, 1))
DAY, HOUR = timedelta(days=1), timedelta(hours=1)
FLAGSHIP = "ar1_insample"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, gaps: bool = False) -> Pipeline:
    """time, event_id, user_id, event_type, value; ``gaps``: every seventh value is missing."""
    df = read(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    if gaps:
        df = df.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return src.table(df, time="ts", order=("event_id",))


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, k) for c, k in places.items()})


EV = "select ts time, event_id, user_id, event_type, value from events where ts >= '2024-01-01' and ts < '2024-02-01'"
GAP = "select ts time, event_id, user_id, event_type, case when event_id % 7 <> 0 then value end as value from events where ts >= '2024-01-01' and ts < '2024-02-01'"
W = "(partition by user_id order by time, event_id)"


@query("select ts time, event_id, value from events where ts >= '2024-01-05' and ts < '2024-01-20'")
def span_filter(spark, d):
    return events(spark, d).load(SHORT).select(TIME, "event_id", "value")


@query("select * from (select 0 k, 0.0 v) where false")
def emptyframe(spark, d):
    return src.empty_frame(spark, "k int, v double").load(MONTH)


@query("select t time from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) t)")
def clock(spark, d):
    return src.clock(spark, HOUR).load(MONTH)


@query("select ts time, event_id, 0 part from events where ts < '2024-01-10' union all select ts, event_id, 1 from events where ts >= '2024-01-20'")
def concatenate(spark, d):
    e = events(spark, d)
    a, b = (e | rows.filter_rows(x) for x in ("time < timestamp_ntz'2024-01-10'", "time >= timestamp_ntz'2024-01-20'"))
    return src.concatenate(a, b).load(MONTH).select(TIME, "event_id", F.col("_part").alias("part"))


@query("select ts time, event_id, case when event_type = 'purchase' then value end as value, (event_type <> 'purchase')::int part from events where event_type in ('purchase', 'click') order by time, part")
def merge(spark, d):
    e = events(spark, d)
    a = e | rows.filter_rows("event_type = 'purchase'")
    b = e | rows.filter_rows("event_type = 'click'") | rows.drop_columns("value")
    return src.merge(a, b).load(MONTH).select(TIME, "event_id", "value", F.col("_part").alias("part"))


@query("select ts time, event_id, value from events where value > 50 and event_type = 'click'")
def filterrows(spark, d):
    return (events(spark, d) | rows.filter_rows("value > 50 and event_type = 'click'")).load(MONTH).select(TIME, "event_id", "value")


@query("select ts time, event_id, round(value * 2 + 1, 6) double_value, upper(event_type) kind from events")
def addcolumns(spark, d):
    return (events(spark, d) | rows.add_columns(double_value="round(value * 2 + 1, 6)", kind="upper(event_type)")).load(MONTH).select(TIME, "event_id", "double_value", "kind")


@query("select ts time, event_id, value, event_type from events")
def selectcolumns(spark, d):
    return (events(spark, d) | rows.select_columns("value", match="^event_")).load(MONTH)


@query("select ts time, event_id, event_type from events")
def dropcolumns(spark, d):
    return (events(spark, d) | rows.drop_columns(match="^(value|user_id)$")).load(MONTH)


@query("select ts time, value, event_id, user_id, event_type from events")
def reordercolumns(spark, d):
    return (events(spark, d) | rows.reorder_columns("value")).load(MONTH)


@query("select ts + interval 1 hour time, event_id from events where ts < timestamp '2024-02-01' - interval 1 hour")
def lag(spark, d):
    return (events(spark, d) | rows.lag(HOUR)).load(MONTH).select(TIME, "event_id")


@query("select ts - interval 1 hour time, event_id from events where ts >= timestamp '2024-01-01' + interval 1 hour")
def lead(spark, d):
    return (events(spark, d) | rows.lead(HOUR)).load(MONTH).select(TIME, "event_id")


@query("select ts + interval 2 hour time, event_id from events where ts < timestamp '2024-02-01' - interval 2 hour")
def settime(spark, d):
    return (events(spark, d) | rows.set_time("time + interval 2 hour")).load(MONTH).select(TIME, "event_id")


@query("select ts - interval 2 hour time, event_id from events where ts >= timestamp '2024-01-01' + interval 2 hour")
def acausal_settime(spark, d):
    return (events(spark, d) | rows.acausal_set_time("time - interval 2 hour")).load(MONTH).select(TIME, "event_id")


@query("select ts time, event_id, value from events order by ts, event_id limit 25")
def head(spark, d):
    return (events(spark, d) | rows.head(25)).load(MONTH).select(TIME, "event_id", "value")


@query(f"select timestamp '2024-02-01' time, user_id, event_id, value from ({EV}) qualify row_number() over (partition by user_id order by time desc, event_id desc) = 1")
def lastrow(spark, d):
    return (events(spark, d) | rows.last_row("user_id")).load(MONTH).select(TIME, "user_id", "event_id", "value")


@query("select o_orderdate time, o_orderkey, row_number() over (partition by o_orderdate order by o_totalprice desc, o_orderkey) place from orders")
def sortcycles(spark, d):
    p = src.table(read(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), "o_orderdate", ("o_orderkey",)) | rows.sort_cycles("o_totalprice", rev=True)
    df = p.load(YEARS)
    return df.select(TIME, "o_orderkey", F.row_number().over(p.window((TIME,))).alias("place").cast("long"))


@query(f"select time, event_id, last_value(value ignore nulls) over (partition by user_id order by time, event_id rows unbounded preceding) as value from ({GAP})")
def forwardfill(spark, d):
    return (events(spark, d, True) | rows.forward_fill("value", key="user_id")).load(MONTH).select(TIME, "event_id", "value")


@query(f"with g as ({GAP}), s as (select *, last_value(case when value is not null then {{'t': time, 'v': value}} end ignore nulls) over (partition by user_id order by time, event_id rows unbounded preceding) l from g) select time, event_id, case when time - l.t <= interval 12 hour then l.v end as value from s")
def forwardfill_tolerance(spark, d):
    return (events(spark, d, True) | rows.forward_fill("value", key="user_id", tolerance=timedelta(hours=12))).load(MONTH).select(TIME, "event_id", "value")


@query(f"select time, event_id, coalesce(value, -1.0) as value from ({GAP})")
def fillmissing(spark, d):
    return (events(spark, d, True) | rows.fill_missing(value=-1.0)).load(MONTH).select(TIME, "event_id", "value")


ALL = (S.Count(), S.CountDistinct("event_type"), S.Sum("value"), S.Mean("value"), S.Min("value"), S.Max("value"), S.First("value"), S.Last("value"), S.SumPower("value", 2), S.Moment("value", 3), S.Variance("value"), S.Std("value", corrected=False), S.DotProduct("value", "event_id"), S.Correlation("value", "event_id"), S.Covariance("value", "event_id"))
ALL_ROUND = dict(value_sum=4, value_mean=6, value_sumpower_2=2, value_moment_3=1, value_variance=4, value_std=5, value_event_id_dotproduct=0, value_event_id_correlation=6, value_event_id_covariance=1)
ALL_SQL = """count(*) count, count(distinct event_type) event_type_countdistinct, round(sum(value), 4) value_sum, round(avg(value), 6) value_mean, min(value) value_min, max(value) value_max,
  arg_min(value, (time, event_id)) value_first, arg_max(value, (time, event_id)) value_last, round(sum(value * value), 2) value_sumpower_2, round(avg(value * value * value), 1) value_moment_3,
  round(var_samp(value), 4) value_variance, round(stddev_pop(value), 5) value_std, round(sum(value * event_id), 0) value_event_id_dotproduct,
  round(corr(value, event_id), 6) value_event_id_correlation, round(covar_samp(value, event_id), 1) value_event_id_covariance"""


@query(f"select timestamp '2024-02-01' time, event_type kind, {ALL_SQL} from ({EV}) group by event_type")
def summarize_all(spark, d):
    p = events(spark, d) | rows.add_columns(kind="event_type") | summarize.summarize(*ALL, key="kind")
    return rounded(p.load(MONTH), **ALL_ROUND)


@query(f"select timestamp '2024-02-01' time, user_id, round(exp(sum(ln(1 + value / 1000))), 6) v_product from ({EV}) group by user_id")
def summarize_product(spark, d):
    p = events(spark, d) | rows.add_columns(v="1 + value / 1000") | summarize.summarize(S.Product("v"), key="user_id")
    return rounded(p.load(MONTH), v_product=6)


@query("select o_orderdate time, count(*) count, round(sum(o_totalprice), 2) o_totalprice_sum from orders group by 1")
def summarizecycles(spark, d):
    p = src.table(read(spark, d, "orders"), "o_orderdate", ("o_orderkey",)) | summarize.summarize_cycles(S.Count(), S.Sum("o_totalprice"))
    return rounded(p.load(YEARS), o_totalprice_sum=2)


@query("with t as (select distinct o_orderdate time from orders), k as (select * from (values ('O'), ('F'), ('X')) k(o_orderstatus)), a as (select o_orderdate time, o_orderstatus, count(*) n, max(o_totalprice) m from orders group by all) select t.time, k.o_orderstatus, coalesce(n, 0) count, m o_totalprice_max from t cross join k left join a using (time, o_orderstatus)")
def summarizecycles_dense(spark, d):
    keys = spark.createDataFrame([("O",), ("F",), ("X",)], "o_orderstatus string")
    return (src.table(read(spark, d, "orders"), "o_orderdate", ("o_orderkey",)) | summarize.summarize_cycles(S.Count(), S.Max("o_totalprice"), key="o_orderstatus", keyset=keys)).load(YEARS)


@query(f"select time, event_id, count(*) over w count, round(sum(value) over w, 4) value_sum, max(value) over w value_max, round(var_samp(value) over w + 1e-8, 6) value_variance from ({EV}) window w as (partition by user_id order by time, event_id rows unbounded preceding)")
def addsummarycolumns(spark, d):
    p = events(spark, d) | summarize.add_summary_columns(S.Count(), S.Sum("value"), S.Max("value"), S.Variance("value"), key="user_id")
    return rounded(p.load(MONTH).withColumn("value_variance", F.col("value_variance") + 1e-8), value_sum=4, value_variance=6).select(TIME, "event_id", "count", "value_sum", "value_max", "value_variance")  # off exact ties


@query("select ts time, event_id, round(sum(value) over w, 4) d_value_sum, count(*) over w d_count from events window w as (partition by user_id order by ts range between interval 1 day preceding and current row)")
def addrollingcolumns(spark, d):
    p = events(spark, d) | summarize.add_rolling_columns({"d": DAY}, S.Sum("value"), S.Count(), key="user_id")
    return rounded(p.load(MONTH), d_value_sum=4).select(TIME, "event_id", "d_value_sum", "d_count")


@query("""with u as (select ts time, event_id, user_id, event_type = 'purchase' as bought, value from events where event_type in ('purchase', 'click')
 union all select ts, event_id, user_id, null, null from events where event_type not in ('purchase', 'click')),
 s as (select time, event_id, bought is distinct from true as own, round(sum(case when bought then value end) over (partition by user_id order by time range between interval 1 day preceding and current row), 4) d_value_sum from u)
 select time, event_id, d_value_sum from s where own""")
def addrollingcolumns_from(spark, d):
    e = events(spark, d)
    p = (e | rows.filter_rows("event_type <> 'purchase'")) | summarize.add_rolling_columns({"d": DAY}, S.Sum("value"), key="user_id", source=e | rows.filter_rows("event_type = 'purchase'"))
    return rounded(p.load(MONTH), d_value_sum=4).select(TIME, "event_id", "d_value_sum")


@query("select ts time, event_id, round(sum(value) over w, 4) d_value_sum, max(value) over w d_value_max from events window w as (order by ts range between interval 6 hour preceding and current row)")
def addrollingcolumns_unkeyed(spark, d):
    p = events(spark, d) | summarize.add_rolling_columns({"d": timedelta(hours=6)}, S.Sum("value"), S.Max("value"))
    return rounded(p.load(MONTH), d_value_sum=4).select(TIME, "event_id", "d_value_sum", "d_value_max")


@query("with t as (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-31', interval 1 day)) time), k as (select distinct event_type from events), a as (select date_trunc('day', ts) + interval 1 day time, event_type, count(*) n, round(sum(value), 4) s from events group by all) select time, event_type, coalesce(n, 0) count, s value_sum from t cross join k left join a using (time, event_type)")
def intervalize(spark, d):
    keys = read(spark, d, "events").select("event_type").distinct()
    p = events(spark, d) | summarize.intervalize(src.clock(spark, DAY), S.Count(), S.Sum("value"), key="event_type", keyset=keys)
    return rounded(p.load(MONTH), value_sum=4)


@query("with t as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) time) select t.time, count(e.event_id) count, round(avg(value), 6) value_mean from t left join events e on e.ts >= t.time - interval 3 day and e.ts < t.time group by t.time")
def summarizewindows(spark, d):
    p = events(spark, d) | summarize.summarize_windows(src.clock(spark, DAY), timedelta(days=3), S.Count(), S.Mean("value"), interval=DAY)
    return rounded(p.load(MONTH), value_mean=6)


def _purchases(spark, d) -> Pipeline:
    return events(spark, d) | rows.filter_rows("event_type = 'purchase'") | rows.select_columns("user_id", "value")


def _asof_sql(op: str, extra: str = "") -> str:
    return f"with e as ({EV}), p as (select * from e where event_type = 'purchase') select e.time, e.event_id, {'case when ' + extra + ' then p.value end' if extra else 'p.value'} p_value from e asof left join p on e.user_id = p.user_id and e.time {op} p.time"


def _asof(spark, d, **options):
    return (events(spark, d) | joins.asof_join(_purchases(spark, d), key="user_id", right_prefix="p", **options)).load(MONTH).select(TIME, "event_id", "p_value")


@query(_asof_sql(">="))
def asofjoin(spark, d):
    return _asof(spark, d)


@query(_asof_sql(">"))
def asofjoin_strict(spark, d):
    return _asof(spark, d, strict=True)


@query(_asof_sql(">=", "e.time - p.time <= interval 24 hour"))
def asofjoin_tolerance(spark, d):
    return _asof(spark, d, tolerance=DAY)


@query(_asof_sql("<="))
def futurejoin(spark, d):
    p = events(spark, d) | joins.future_join(_purchases(spark, d), key="user_id", right_prefix="p")
    return p.load(MONTH).select(TIME, "event_id", "p_value")


def _orders(spark, d) -> Pipeline:
    return src.table(read(spark, d, "orders").select("o_orderdate", "o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderdate", ("o_orderkey",))


@query("select o_orderdate time, o_orderkey, c_mktsegment, c_acctbal from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey")
def lookupjoin(spark, d):
    dim = read(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    return (_orders(spark, d) | joins.lookup_join(dim, "c_custkey")).load(YEARS).select(TIME, "o_orderkey", "c_mktsegment", "c_acctbal")


@query("select o_orderdate time, o_orderkey, c_mktsegment from orders join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey")
def lookupjoin_drop(spark, d):
    dim = read(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    return (_orders(spark, d) | joins.lookup_join(dim, "c_custkey", unmatched="drop")).load(YEARS).select(TIME, "o_orderkey", "c_mktsegment")


@query("select o_orderdate time, o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def lookupjoin_error(spark, d):
    dim = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return (_orders(spark, d) | joins.lookup_join(dim, "c_custkey", unmatched="error")).load(YEARS).select(TIME, "o_orderkey", "c_mktsegment")


@query(f"select time, event_id, lag(value, 1) over {W} value_lag_1, lag(value, 2) over {W} value_lag_2 from ({EV})")
def lags(spark, d):
    return (events(spark, d) | timeseries.lags("value", 2, key="user_id")).load(MONTH).select(TIME, "event_id", "value_lag_1", "value_lag_2")


@query(f"select time, event_id, round(value - lag(value) over {W}, 6) value_diff from ({EV})")
def difference(spark, d):
    return rounded((events(spark, d) | timeseries.difference("value", key="user_id")).load(MONTH), value_diff=6).select(TIME, "event_id", "value_diff")


@query(f"select time, event_id, round(value - 2 * lag(value, 3) over {W} + lag(value, 6) over {W}, 6) value_diff_2_3 from ({EV})")
def difference_2_3(spark, d):
    return rounded((events(spark, d) | timeseries.difference("value", 2, 3, key="user_id")).load(MONTH), value_diff_2_3=6).select(TIME, "event_id", "value_diff_2_3")


@query(f"select time, event_id, case when value > 0 then round(ln(value), 8) else '-infinity'::double end value_log from ({EV})")
def logtransform(spark, d):
    """As its SQL does for missing and negative values, too: all that isn't over 0 is -infinity."""
    df = (events(spark, d) | timeseries.log_transform("value", strict=False)).load(MONTH)
    return df.select(TIME, "event_id", F.when(F.col("value") > 0, F.round("value_log", 8)).otherwise(F.lit(float("-inf"))).alias("value_log"))


@query(f"select time, event_id, round((power(value, 0.5) - 1) / 0.5, 8) value_boxcox from ({EV})")
def boxcox(spark, d):
    return rounded((events(spark, d) | timeseries.box_cox("value", 0.5)).load(MONTH), value_boxcox=8).select(TIME, "event_id", "value_boxcox")


def _ema_sql(alpha: str, source: str = GAP) -> str:
    """A recursion over each user's row numbers; ``t`` is the time of the last folded row."""
    return f"""with recursive r as materialized (select *, row_number() over {W} n from ({source})),
 e(user_id, n, time, event_id, s, t) as (
  select user_id, n, time, event_id, value, case when value is not null then time end from r where n = 1
  union all select r.user_id, r.n, r.time, r.event_id, case when r.value is null then e.s when e.s is null then r.value else e.s + ({alpha}) * (r.value - e.s) end,
   case when r.value is not null then r.time else e.t end from e join r on r.user_id = e.user_id and r.n = e.n + 1)"""


@query(_ema_sql("2.0 / 11") + " select time, event_id, round(s, 6) value_ema_10 from e")
def ema_span(spark, d):
    return rounded((events(spark, d, True) | timeseries.ema("value", span=10, key="user_id")).load(MONTH), value_ema_10=6).select(TIME, "event_id", "value_ema_10")


@query(_ema_sql("1 - exp(-ln(2.0) * (epoch_us(r.time) - epoch_us(e.t)) / 3600000000.0)") + " select time, event_id, round(s, 6) value_ema_hl_1hour from e")
def ema_halflife(spark, d):
    return rounded((events(spark, d, True) | timeseries.ema("value", halflife=HOUR, key="user_id")).load(MONTH), value_ema_hl_1hour=6).select(TIME, "event_id", "value_ema_hl_1hour")


@query(f"""with recursive r as materialized (select *, row_number() over {W} n from ({EV})),
 e(user_id, n, event_id, time, a, b, g) as (select user_id, n, event_id, time, value, value, 0.0::double from r where n = 1
  union all select r.user_id, r.n, r.event_id, r.time, e.a + 2.0 / 13 * (r.value - e.a), e.b + 2.0 / 27 * (r.value - e.b),
   e.g + 0.2 * ((e.a + 2.0 / 13 * (r.value - e.a)) - (e.b + 2.0 / 27 * (r.value - e.b)) - e.g) from e join r on r.user_id = e.user_id and r.n = e.n + 1)
 select time, event_id, round(a - b, 6) macd, round(g, 6) macd_signal, round(a - b - g, 6) macd_hist from e""")
def macd(spark, d):
    return rounded((events(spark, d) | timeseries.macd("value", key="user_id")).load(MONTH), macd=6, macd_signal=6, macd_hist=6).select(TIME, "event_id", "macd", "macd_signal", "macd_hist")


@query(f"select timestamp '2024-02-01' time, event_type, round(regr_intercept(value, event_id), 5) intercept_beta, round(regr_slope(value, event_id), 8) event_id_beta, round(regr_r2(value, event_id), 8) r2, count(*) n from ({EV}) group by event_type")
def linear_regression(spark, d):
    p = events(spark, d) | summarize.summarize(S.LinearRegression("event_id", response="value"), key="event_type")
    return rounded(p.load(MONTH), intercept_beta=5, event_id_beta=8, r2=8)


LAGGED = f"select *, lag(value) over (partition by event_type order by time, event_id) l from ({EV})"


@query(f"select timestamp '2024-02-01' time, event_type, round(regr_intercept(value, l), 6) ar_intercept_beta, round(regr_slope(value, l), 6) ar_value_lag_1_beta, round(regr_r2(value, l), 6) ar_r2, count(*) ar_n from ({LAGGED}) where l is not null group by event_type")
def ar1(spark, d):
    return rounded((events(spark, d) | timeseries.ar("value", 1, key="event_type")).load(MONTH), ar_intercept_beta=6, ar_value_lag_1_beta=6, ar_r2=6)


@query(f"with g as ({LAGGED}), c as (select event_type, regr_intercept(value, l) b0, regr_slope(value, l) b1 from g where l is not null group by 1) select time, event_id, round(b0 + b1 * l, 6) value_fitted, round(value - (b0 + b1 * l), 6) value_residual from g join c using (event_type)")
def ar1_insample(spark, d):
    p = events(spark, d) | timeseries.fit("ar", "value", key="event_type", p=1)["insample"]
    return rounded(p.load(MONTH), value_fitted=6, value_residual=6).select(TIME, "event_id", "value_fitted", "value_residual")


@query("with t as (select * from events where ts >= '2024-01-05' and ts < '2024-01-20') select timestamp '2024-01-20' time, user_id, count(*) count, round(avg(value), 6) value_mean from t group by user_id")
def fitonce(spark, d):
    p = events(spark, d) | timeseries.fit_once(SHORT, summarize.summarize(S.Count(), S.Mean("value"), key="user_id"))
    return rounded(p.load(MONTH), value_mean=6)


def daily(spark: SparkSession, d: str) -> Pipeline:
    df = read(spark, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias(TIME)).agg(F.sum("value").alias("total"))
    return src.table(df)


DAILY = "select date_trunc('day', ts) time, sum(value) total from events group by 1"


@query(f"select timestamp '2024-02-01' time, 'ok' status, count(*)::int nobs, round(avg(total), 4) mean, round(var_pop(total), 1) variance, round(-0.5 * count(*) * (ln(2 * pi() * var_pop(total)) + 1), 4) loglik from ({DAILY})")
def fitarma(spark, d):
    """Order (0, 0, 0) with a mean has closed-form estimates; other orders are compared in tests."""
    p = daily(spark, d) | timeseries.fit_arma("total", (0, 0, 0), include_mean=True)
    m = F.col("model")
    return p.load(MONTH).select(TIME, m["status"].alias("status"), m["nobs"].alias("nobs"), F.round(m["coefs"][0], 4).alias("mean"), F.round(m["coefs"][1], 1).alias("variance"), F.round(m["loglik"], 4).alias("loglik"))


#: An ARMA(1, 1) model with a mean as a literal: phi 0.6, theta 0.3, sigma^2 4.
MODEL = dict(order=[1, 0, 1], seasonal_order=[0, 0, 0, 0], include_mean=True, names=["mean", "ar_L1", "ma_L1", "sigma2_η"], coefs=[5000.0, 0.6, 0.3, 4.0], loglik=0.0, aic=0.0, aicc=0.0, bic=0.0, nobs=0, status="ok", message="", model_id="literal")


def _model(spark: SparkSession) -> Pipeline:
    from meridia.functions.arma import MODEL_SCHEMA

    return src.table(spark.createDataFrame([(datetime(2024, 1, 1), tuple(MODEL.values()))], f"time timestamp_ntz, model struct<{MODEL_SCHEMA}>"))


@query("""with recursive g as materialized (select *, row_number() over (order by time) n from (select date_trunc('day', ts) time, case when day(ts) % 7 <> 3 then sum(value) end total from events group by date_trunc('day', ts), day(ts))),
 k(n, time, total, a, p) as (select 0::bigint, null::timestamp, null::double, 0.0::double, 4 * (1 + 2 * 0.6 * 0.3 + 0.09) / (1 - 0.36) union all
  select g.n, g.time, g.total,
   case when k.n = 0 then 0.0 when k.total is null then 0.6 * k.a else 0.6 * (k.a + (k.total - 5000 - k.a)) + 0.3 * 4 / k.p * (k.total - 5000 - k.a) end,
   case when k.n = 0 then k.p when k.total is null then 0.36 * k.p + 2 * 0.6 * 0.3 * 4 + 0.09 * 4 + 4 else 4 + 0.09 * 4 - (0.3 * 4) * (0.3 * 4) / k.p end
  from k join g on g.n = k.n + 1)
 select time, total, round(5000 + a, 4) total_fitted, round(total - 5000 - a, 4) total_residual, round((total - 5000 - a) / sqrt(p), 4) total_stdresidual,
  round(5000 + case when total is null then 0.6 * a else 0.6 * (total - 5000) + 1.2 / p * (total - 5000 - a) end, 4) total_forecast_1,
  round(5000 + 0.6 * case when total is null then 0.6 * a else 0.6 * (total - 5000) + 1.2 / p * (total - 5000 - a) end, 4) total_forecast_2 from k where n > 0""")
def applyarma(spark, d):
    gaps = daily(spark, d) | (lambda p: p.then(lambda df, _: df.withColumn("total", F.when(F.dayofmonth(TIME) % 7 != 3, F.col("total")))))
    out = (gaps | timeseries.apply_arma(_model(spark), "total", horizon=2)).load(MONTH)
    return rounded(out, **dict.fromkeys(["total_fitted", "total_residual", "total_stdresidual", "total_forecast_1", "total_forecast_2"], 4))


@query(f"with d as ({DAILY}), t as (select unnest([timestamp '2024-01-01', timestamp '2024-01-11', timestamp '2024-01-21', timestamp '2024-01-31']) tick), m as (select tick, avg(total) mu, var_pop(total) v from t left join d on d.time >= tick - interval 12 day and d.time < tick group by tick) select time, total, round(mu, 4) total_fitted, round(total - mu, 4) total_residual, round((total - mu) / sqrt(v), 4) total_stdresidual from d asof left join m on d.time >= m.tick")
def arma(spark, d):
    """Order (0, 0, 0) with a mean: each fit is the mean of the days before its tick."""
    out = (daily(spark, d) | timeseries.arma(src.clock(spark, timedelta(days=10)), timedelta(days=12), "total", (0, 0, 0), include_mean=True)).load(MONTH)
    return rounded(out, total_fitted=4, total_residual=4, total_stdresidual=4)


@query(f"with x as (select time, total - (select avg(total) from ({DAILY})) z from ({DAILY})), l as (select z, lag(z, 1) over (order by time) l1, lag(z, 2) over (order by time) l2, lag(z, 3) over (order by time) l3 from x) select k lag, round(r, 6) r from (select unnest([0, 1, 2, 3]) k, unnest([1.0, sum(z * l1) / sum(z * z), sum(z * l2) / sum(z * z), sum(z * l3) / sum(z * z)]) r from l)")
def acf(spark, d):
    from meridia.functions.diagnostics import acf_table

    p = daily(spark, d)
    return acf_table(p, p.load(MONTH), "total", 3).select("lag", F.round("r", 6).alias("r"))


@query("with s as (select value, min(value) over () lo, max(value) over () hi from events) select least(19, floor((value - lo) / ((hi - lo) / 20)))::int bin, count(*) count from s group by 1")
def histogram(spark, d):
    from meridia.functions.diagnostics import histogram_table

    return histogram_table(events(spark, d).load(MONTH), "value", bins=20).select("bin", "count")


@query("select ts time, event_id, value from events order by ts, event_id limit 50 offset 100")
def preview(spark, d):
    p = events(spark, d)
    return rows.page(p, p.load(MONTH), 100, 50).select(TIME, "event_id", "value")


@query(f"select 'value' as column_name, count(value) n, count(*) - count(value) missing, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, min(value) min, max(value) max, arg_min(value, (time, event_id)) filter (value is not null) first, arg_max(value, (time, event_id)) filter (value is not null) last from ({GAP})")
def summary(spark, d):
    from meridia.functions.diagnostics import summary_table

    p = events(spark, d, True)
    return rounded(summary_table(p, p.load(MONTH), ["value"]), mean=6, std=6)


from meridia.plans import uses  # noqa: E402, F401  (registers its queries here)
