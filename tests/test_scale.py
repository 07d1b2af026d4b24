"""Plans without a range join or a task that takes all rows, and columns that pass through unchanged."""

import random

import pytest
from pyspark.sql import functions as F

from meridia import sources as src
from meridia.functions import summarizers as S
from meridia.operators import joins, rows, summarize, timeseries
from meridia.pipeline import Pipeline
from meridia.span import Span

WINDOW = Span(0, 5000)


def mean_model():
    class Mean:  # a local class travels to the executors by value
        def fit(self, x, y):
            self.y = float(y.mean())

        def predict(self, x):
            return [self.y] * len(x)

    return Mean()


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(8)
    made = [(rnd.choice((rnd.randrange(40), rnd.randrange(5000))), i, 1, rnd.choice((None, float(rnd.randrange(1, 9)))), 2**53 + 1 + i, [(i, "n")]) for i in range(600)]
    df = spark.createDataFrame(made, "time long, id long, one int, x double, big long, nested array<struct<a:long,b:string>>")
    return src.table(df.withColumn("big", F.when(F.col("id") % 5 != 0, F.col("big"))), order=("id",))


def collected(p, span=WINDOW):
    df = p.load(span)
    shown = [c for c in df.columns if c != "one"]
    return sorted(str([round(v, 7) if isinstance(v, float) else v for v in r]) for r in df.select(*shown).collect())


def clocks(spark):
    regular = src.clock(spark, 100)
    uneven = src.table(spark.createDataFrame([(t,) for t in (0, 100, 150, 700, 701, 2500, 4999)], "time long"))
    return regular, uneven


@pytest.mark.parametrize("make", [
    lambda key: timeseries.ema("x", span=7, key=key), lambda key: timeseries.ema("x", halflife=30, key=key), lambda key: timeseries.macd("x", 3, 6, 4, key=key),
    lambda key: summarize.add_rolling_columns({"a": 37, "b": 5}, S.Sum("x"), S.Count(), S.Min("x"), key=key),
])
@pytest.mark.parametrize("span", [WINDOW, Span(0, 40), Span(-10**7, 10**7)])
def test_without_key_as_with_one(data, make, span):
    assert collected(data | make(None), span) == collected(data | make("one"), span)


def test_other_columns_pass_unchanged(data):
    kept = lambda p: sorted(map(str, p.load(WINDOW).select("id", "big", "nested").collect()))
    models = data | rows.filter_rows("x is not null") | timeseries.fit_once(WINDOW, timeseries.fit_arma("x"))
    at_start = Pipeline(lambda span: models.plan(span).withColumn("time", F.lit(0).cast("long")))
    want = kept(data)
    for key in (None, "one"):
        assert kept(data | timeseries.ema("x", span=3, key=key)) == kept(data | timeseries.macd("x", key=key)) == want
    assert kept(data | timeseries.apply_arma(at_start, "x", key=None)) == want


def brute_windows(data, ticks, back):
    got = data.load(WINDOW).collect()
    return {t: sum(t - back <= r["time"] < t for r in got) for t in ticks}


def test_windows_of_any_clock(spark, data):
    for clock in clocks(spark):
        ticks = sorted(r["time"] for r in clock.load(WINDOW).collect())
        for back in (30, 400):
            out = (data | summarize.summarize_windows(clock, back, S.Count())).load(WINDOW).collect()
            assert {r["time"]: r["count"] for r in out} == brute_windows(data, ticks, back)
        for close in (False, True):
            out = (data | summarize.intervalize(clock, S.Count(), closelast=close)).load(WINDOW).collect()
            ends = [*ticks[1:], *([5000] if close else [])]
            got = data.load(WINDOW).collect()
            assert {r["time"]: r["count"] for r in out} == {b: sum(a <= r["time"] < b for r in got) for a, b in zip(ticks, ends)}


def test_intervals_of_fractions(spark):
    df = spark.createDataFrame([(k / 10, k) for k in range(100)], "time double, k int")
    out = (src.table(df) | summarize.intervalize(src.clock(spark, 0.1), S.Count(), closelast=True)).load(Span(0.0, 10.0)).collect()
    assert len(out) == 100 and sum(r["count"] for r in out) == 100 and {r["count"] for r in out} <= {0, 1, 2}


def test_plans_hold_at_scale(spark, data):
    ema = data | timeseries.ema("x", span=5)
    for clock in clocks(spark):
        models = [
            data | timeseries.arma(clock, 300, "x", key="one"), data | timeseries.add_predictions(clock, 300, mean_model(), ["big"], "x", key="one"),
            data | summarize.summarize_windows(clock, 50, S.Count(), key="one"), data | summarize.intervalize(clock, S.Count(), key="one"),
        ]
        for p in models:
            plan = p.load(WINDOW)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    for p in (ema, data | timeseries.macd("x"), data | summarize.add_rolling_columns({"w": 9}, S.Sum("x"))):
        df = p.load(WINDOW)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 1," not in plan and "NestedLoop" not in plan
        assert "hashpartitioning(#b" in df._jdf.queryExecution().executedPlan().toString()


def test_models_predict_after_ticks(spark, data):
    clock = src.clock(spark, 1000)
    out = (data | timeseries.add_predictions(clock, 1000, mean_model(), ["id"], "x", key="one", name="guess")).load(WINDOW).collect()
    known = [r for r in out if r["x"] is not None]
    for r in out:
        tick = r["time"] // 1000 * 1000
        base = [k["x"] for k in known if tick - 1000 <= k["time"] < tick]
        assert not base or r["guess"] == pytest.approx(sum(base) / len(base))


@pytest.mark.parametrize("options", [{}, {"strict": True}, {"tolerance": 20}])
@pytest.mark.parametrize("join", [joins.asof_join, joins.future_join])
def test_keys_in_blocks(data, join, options):
    left = data | rows.add_columns(k="case when id % 3 = 0 then null else id % 2 end")
    right = left | rows.filter_rows("x = 3") | rows.select_columns("id", "k", "x")
    same = [collected(left | join(right, key="k", right_prefix="r", split_keys=split, **options)) for split in (False, True)]
    assert same[0] == same[1]
    for step in (lambda split: timeseries.ema("x", span=4, key="k", split_keys=split), lambda split: timeseries.ema("x", halflife=9, key="k", split_keys=split), lambda split: timeseries.macd("x", 3, 5, 2, key="k", split_keys=split)):
        assert collected(left | step(False)) == collected(left | step(True))
    filled = [collected(left | rows.forward_fill("x", key="k", split_keys=split)) for split in (False, True)]
    assert filled[0] == filled[1]


def test_lookups_plan_without_a_job(spark, data):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "one int, label string")
    p = data | joins.lookup_join(twice, "one")
    plan = p.load(WINDOW)  # nothing runs yet
    with pytest.raises(Exception, match="repeats a key"):
        plan.count() if plan.select("label").collect() else None
    assert (data | joins.lookup_join(twice.limit(1), "one", unmatched="drop")).load(WINDOW).count() == 600
