"""Windows without a key against the same windows with a constant key, over gaps, ties, nulls and moved rows."""

import random

import pytest

from meridia import sources as src
from meridia.functions import summarizers as S
from meridia.operators import joins, rows, summarize, timeseries
from meridia.span import Span

WINDOW = Span(0, 5000)


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    made = [(rnd.choice((rnd.randrange(40), rnd.randrange(5000))), i, 1, rnd.choice((None, float(rnd.randrange(9))))) for i in range(700)]
    return src.table(spark.createDataFrame(made, "time long, id long, one int, x double"), order=("id",))


def same(p, q, span=WINDOW):
    left, right = p.load(span), q.load(span)
    assert left.columns == right.columns and left.dtypes == right.dtypes
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


@pytest.mark.parametrize("span", [WINDOW, Span(0, 50), Span(0, 0), Span(-10**9, 10**9)])
def test_running_values(data, span):
    ss = (S.Count(), S.Sum("x"), S.Mean("x"), S.Min("x"), S.Max("x"), S.First("x"), S.Last("x"), S.SumPower("x", 2))
    same(data | summarize.add_summary_columns(*ss), data | summarize.add_summary_columns(*ss, key="one"), span)
    same(data | rows.forward_fill("x"), data | rows.forward_fill("x", key="one"), span)
    same(data | rows.forward_fill("x", tolerance=3), data | rows.forward_fill("x", key="one", tolerance=3), span)


def test_row_lags(data):
    same(data | timeseries.lags("x", 5), data | timeseries.lags("x", 5, key="one"))
    same(data | timeseries.difference("x", 2, 3), data | timeseries.difference("x", 2, 3, key="one"))
    same(data | rows.lag(100) | timeseries.lags("x", 2), data | rows.lag(100) | timeseries.lags("x", 2, key="one"))


@pytest.mark.parametrize("join", [joins.asof_join, joins.future_join])
@pytest.mark.parametrize("options", [{}, {"strict": True}, {"tolerance": 20}])
def test_joins(data, join, options):
    right = data | rows.filter_rows("x = 3") | rows.select_columns("id", "one", "x")
    plain = data | join(right | rows.drop_columns("one"), right_prefix="r", **options)
    same(plain, data | join(right, key="one", right_prefix="r", **options))


def test_no_task_gets_every_row(data):
    p = data | summarize.add_summary_columns(S.Sum("x"))
    plan = p.load(WINDOW)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(#b" in plan
