import json
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle

from meridia import graph as G
from meridia import streaming
from meridia.functions import summarizers as S
from meridia.session import Canceled, Session
from meridia.span import Span


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not see this file


class Mean:
    def fit(self, x, y):
        self.level = float(np.mean(y))

    def predict(self, x):
        return np.full(len(x), self.level)

    predict_mean = predict


def frame(spark):
    rows = [(t, 1 + (t + 1) % 2, float(t), 2.0 * t + 1, None if t == 1 else float(t)) for t in range(1, 11)]
    return spark.createDataFrame(rows, "time long, k long, x double, z double, y double")


@pytest.fixture
def session(spark):
    s = Session(spark, 0, 100, models={"mean": Mean()})
    s.add_table("df", frame(spark))
    s.add_table("quotes", spark.createDataFrame([(0, 1.0), (5, 2.0)], "time long, q double"))
    s.add_table("dim", spark.createDataFrame([(1, "one"), (3, "three")], "k long, label string"), time=None)
    s.set_context("train", 0, 6)
    yield s
    s.cancel()


def chain(s, *kinds):
    at = s.add_node("table", {"table": "df"})
    for kind, params in kinds:
        nxt = s.add_node(kind, params)
        s.connect(at, nxt)
        at = nxt
    return at


def summed(*names):
    return [{"summarizer": n, "columns": [] if n == "Count" else ["x"]} for n in names]


STEPS = {
    "filterrows": ({"predicate": "x > 3"}, 7), "addcolumns": ({"columns": {"w": "x + z"}}, 10), "selectcolumns": ({"columns": "x"}, 10),
    "dropcolumns": ({"match": "^[kx]$"}, 10), "reordercolumns": ({"columns": ["z"]}, 10), "lag": ({"offset": 2}, 10), "lead": ({"offset": 1}, 10),
    "head": ({"n": 3}, 3), "settime": ({"spec": "time + 1"}, 10), "acausal_settime": ({"spec": "time - 1"}, 10), "lastrow": ({"key": "k"}, 2),
    "sortcycles": ({"by": "x", "rev": True}, 10), "forwardfill": ({"columns": ["y"]}, 10), "fillmissing": ({"values": {"y": 0.0}}, 10),
    "summarize": ({"summarizers": summed("Count", "Sum"), "key": "k"}, 2), "summarizecycles": ({"summarizers": summed("Count")}, 10),
    "addsummarycolumns": ({"summarizers": summed("Sum")}, 10), "addrollingcolumns": ({"windows": {"w": 2}, "summarizers": summed("Sum")}, 10),
    "lookupjoin": ({"table": "dim", "key": "k", "unmatched": "drop"}, 5), "lags": ({"column": "x", "p": 2}, 10), "difference": ({"column": "x"}, 10),
    "logtransform": ({"column": "x"}, 10), "boxcox": ({"column": "x", "lambda": 0.5}, 10), "ema": ({"column": "x", "span": 3}, 10),
    "macd": ({"column": "x"}, 10), "ar": ({"column": "x", "p": 1}, 1), "fitarma": ({"column": "x"}, 1), "fit": ({"family": "ar", "column": "x", "p": 1}, 1),
    "fitonce": ({"context": "train", "summarizer": {"summarizer": "Mean", "columns": ["x"]}}, 1),
    "writecsv": ({"path": "/nowhere"}, 10), "writeparquet": ({"path": "/nowhere"}, 10), "writejls": ({"path": "/nowhere"}, 10),
}


@pytest.mark.parametrize("kind", STEPS)
def test_every_step_kind_and_its_script(session, kind):
    params, n = STEPS[kind]
    node = chain(session, (kind, params))
    want = session.load(node)
    assert want.count() == n
    scope = {}
    exec(session.export(node), scope)
    got = scope["build"](session.spark, session.tables, session.models)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_kinds_with_more_ports(session, tmp_path):
    s = session
    df, clock = s.add_node("table", {"table": "df"}), s.add_node("clock", {"interval": 5})
    quotes = s.add_node("table", {"table": "quotes"})

    def made(kind, params, **ports):
        n = s.add_node(kind, params)
        for port, source in ports.items():
            for one in source if isinstance(source, list) else [source]:
                s.connect(one, n, {"in_": "in"}.get(port, port))
        return n

    twelve = Span(0, 12)
    tumbling = made("intervalize", {"summarizers": summed("Count")}, clock=clock, in_=df)
    assert [r["count"] for r in s.load(tumbling, context=twelve).orderBy("time").collect()] == [4, 5]
    hopping = made("summarizewindows", {"lookback": 5, "summarizers": summed("Count")}, clock=clock, in_=df)
    assert [r["count"] for r in s.load(hopping, context=twelve).orderBy("time").collect()] == [0, 4, 5]
    asof = made("asofjoin", {"tolerance": None}, in_=df, right=quotes)
    assert [r["q"] for r in s.load(asof).orderBy("time").collect()] == [1.0] * 4 + [2.0] * 6
    ahead = made("futurejoin", {}, in_=df, right=quotes)
    assert [r["q"] for r in s.load(ahead).orderBy("time").collect()] == [2.0] * 5 + [None] * 5
    assert s.load(made("merge", {}, parts=[df, quotes])).count() == 12
    early, late = (made("filterrows", {"predicate": p}, in_=df) for p in ("time <= 5", "time > 5"))
    assert s.load(made("concatenate", {}, parts=[early, late])).count() == 10
    models = made("fit", {"family": "model", "model": "mean", "predictors": ["z"], "response": "x", "fitcontext": "train"}, in_=df)
    applied = made("applymodels", {"predictors": ["z"], "name": "guess"}, in_=df, models=models)
    assert [r["guess"] for r in s.load(applied).orderBy("time").collect()] == [None] * 5 + [3.0] * 5
    added = made("addpredictions", {"lookback": 5, "model": "mean", "predictors": "z", "response": "x"}, clock=clock, in_=df)
    assert s.load(added).where("prediction is not null").count() == 6
    assert "level" in s.load(made("modelreports", {}, in_=models)).first()["report"]
    fitted = made("fitonce", {"context": "train", "summarizer": {"summarizer": "Mean", "columns": "x"}}, in_=df)
    assert [tuple(r) for r in s.load(fitted).collect()] == [(6, 3.0)]
    arma = made("fit", {"family": "arma", "column": "x", "fitcontext": "train"}, in_=df)
    assert s.load(made("applyarma", {"column": "x", "horizon": 1}, in_=df, models=arma)).count() == 10
    assert s.load(made("arma", {"lookback": 5, "column": "x"}, clock=clock, in_=df)).count() == 10
    assert s.load(s.add_node("emptyframe")).count() == 0
    out = made("writeparquet", {"path": str(tmp_path / "out")}, in_=df)
    s.load(out).count()
    assert not (tmp_path / "out").exists()
    s.write(out)
    for kind in ("readparquet", "readjls"):
        assert s.load(s.add_node(kind, {"path": str(tmp_path / "out")})).count() == 10
    csv = made("writecsv", {"path": str(tmp_path / "csv")}, in_=df)
    s.write(csv)
    assert s.load(s.add_node("readcsv", {"path": str(tmp_path / "csv"), "types": {"time": "long"}})).count() == 10


def test_all_kinds_are_registered():
    assert len([k for k in G.REGISTRY.values() if k.group != "own"]) == 49
    for kind in G.REGISTRY.values():
        json.dumps(kind.schema())


def test_graph_rules():
    g = G.Graph()
    a, b, c = g.add("clock", {"interval": 1}), g.add("lead", {"offset": 1}), g.add("head", {"n": 1})
    e = g.connect(a, b)
    g.connect(b, c)
    for bad in (lambda: g.connect(c, b), lambda: g.connect(a, c), lambda: g.connect(a, a), lambda: g.connect(a, b, "side")):
        with pytest.raises(ValueError):
            bad()
    assert g.topological() == [a, b, c] and g.tainted() == {(b, "out"), (c, "out")}
    with pytest.raises(G.ParameterError):
        g.set_params(c, {"n": True})
    g.disconnect(e)
    g.remove(a)
    assert g.add("head") == "n4" and g.tainted() >= {(b, "out")}
    assert G.Graph.from_dict(json.loads(json.dumps(g.to_dict()))).to_dict() == g.to_dict()
    f = g.add("fit")
    assert (f, "insample") in g.tainted() and (f, "model") not in g.tainted()


def test_runs_keep_results_for_the_equal_context(session):
    events, dropped = session.subscribe()
    node = chain(session, ("head", {"n": 3}))
    assert session.run(node).result(60)[node, "out"].count() == 3
    assert session.status[node] == "ok" and session.kept_bytes > 0 and dropped == [0]
    assert session.load(node).storageLevel.useMemory
    assert not session.load(node, context="train").storageLevel.useMemory
    session.set_position(node, 1, 2)
    assert session.kept_bytes > 0
    session.set_params(node, {"n": 4})
    assert session.kept_bytes == 0 and session.status[node] == "idle" and session.load(node).count() == 4
    assert {events.get().kind for _ in range(events.qsize())} >= {"started", "finished", "invalidated"}


def test_the_newest_result_stays_in_a_small_cache(session):
    session.budget = 1
    first, second = chain(session, ("head", {"n": 3})), chain(session, ("head", {"n": 2}))
    session.run(first, second).result(60)
    assert [k[0] for k in session._kept] == [second]


def test_errors_name_the_innermost_node(session):
    bad = chain(session, ("addcolumns", {"columns": {"w": "if(x > 5, raise_error('too far'), x)"}}))
    below = session.add_node("head", {"n": 99})
    session.connect(bad, below)
    with pytest.raises(G.NodeError, match="too far"):
        session.run(below).result(60)
    assert session.status[bad] == "error" and session.status[below] == "blocked" and "too far" in session.errors[bad]
    session.set_params(bad, {"columns": {"w": "nothing"}})
    with pytest.raises(G.NodeError) as e:
        session.load(below)
    assert e.value.node == bad
    with pytest.raises(G.NodeError, match="needs n"):
        session.load(chain(session, ("head", {})))


def test_a_new_run_cancels_the_old(session):
    slow = chain(session, ("addcolumns", {"columns": {"w": "java_method('java.lang.Thread', 'sleep', 3000L)"}}))
    quick = chain(session, ("head", {"n": 1}))
    old = session.run(slow)
    assert session.run(quick).result(60)[quick, "out"].count() == 1
    with pytest.raises(Canceled):
        old.result(60)
    assert all(k[0] == quick for k in session._kept)


def test_prelude_and_contexts(session):
    session.set_prelude(["create or replace temporary function twice(v double) returns double return v * 2"])
    node = chain(session, ("addcolumns", {"columns": {"w": "twice(x)"}}))
    assert session.load(node).agg({"w": "max"}).first()[0] == 20.0
    with pytest.raises(Exception):
        session.set_prelude(["create or replace temporary function twice(v double) returns double return v *"])
    assert session.load(node).agg({"w": "max"}).first()[0] == 20.0
    with pytest.raises(ValueError):
        session.remove_context("analysis")


def test_freeze_save_and_open(session, spark, tmp_path):
    node = chain(session, ("summarize", {"summarizers": summed("Count")}))
    frozen = session.freeze(node, "cold", str(tmp_path / "frozen"))
    assert [tuple(r) for r in session.load(frozen).collect()] == [(100, 10)]
    with pytest.raises(G.NodeError, match="outside"):
        session.load(frozen, context=Span(-1, 100))
    session.save(str(tmp_path / "saved"))
    other = Session(spark, 0, 1)
    other.open(str(tmp_path / "saved"))
    assert [tuple(r) for r in other.load(frozen).collect()] == [(100, 10)] and other.contexts == session.contexts
    assert other.add_node("head") not in session.graph.nodes
    spark.createDataFrame([("{}",)], "value string").write.text(str(tmp_path / "bad" / "session"))
    before = other.graph.to_dict()
    with pytest.raises(ValueError):
        other.open(str(tmp_path / "bad"))
    assert other.graph.to_dict() == before


def test_diagnostics_take_degrees_of_freedom_from_the_fit(session):
    df = session.add_node("table", {"table": "df"})
    models, applied = session.add_node("fit", {"family": "arma", "column": "x", "order": [1, 0, 1]}), session.add_node("applyarma", {"column": "x"})
    session.connect(df, models)
    session.connect(df, applied)
    session.connect(models, applied, "models", "model")
    assert session._fit_facts(applied)["dof"] == 2
    assert session.diagnostic(df, "acf", "x", lags=2).data


def test_streams(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=m), m % 2, float(m)) for m in range(60)]
    schema = "time timestamp, k long, x double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), schema, watermark="0 seconds")

    def ran(out, name, mode="append"):
        q = streaming.write_stream(out, str(tmp_path / name), str(tmp_path / f"{name}_c"), mode)
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(str(tmp_path / name))

    ten = ran(streaming.intervalize(stream, timedelta(minutes=10), S.Count(), S.Sum("x"), key="k"), "ten")
    assert {(r["time"].minute, r["k"]): r["x_sum"] for r in ten.collect()}[20, 1] == 11 + 13 + 15 + 17 + 19
    hops = ran(streaming.summarize_windows(stream, timedelta(minutes=10), timedelta(minutes=20), S.Count()), "hops")
    assert {r["time"].minute: r["count"] for r in hops.collect() if r["time"].hour == 0}[30] == 20
    seen = ran(streaming.ema(stream, "x", 3, "k"), "ema")
    got = {r["time"].minute: r["x_ema_3"] for r in seen.collect()}
    assert got[0] == 0.0 and got[2] == 1.0 and got[4] == 2.5 and len(got) == 60
