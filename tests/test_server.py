"""A session over HTTP and by an agent's messages."""

import io
import json
import math
import random
import urllib.error
import urllib.request

import pytest

from meridia.agent import Agent
from meridia.commands import Commands
from meridia.server import Server
from meridia.session import Session


@pytest.fixture
def session(spark):
    rnd, x, rows = random.Random(2), 0.0, []
    for t in range(80):
        x = 0.6 * x + rnd.gauss(0, 1)
        rows.append((t, "a" if t % 2 else "b", x))
    s = Session(spark, 0, 81)
    s.add_table("df", spark.createDataFrame(rows, "time long, k string, x double"))
    s.set_context("train", 0, 41)
    return s


@pytest.fixture
def server(session, tmp_path):
    s = Server(session, str(tmp_path)).start()
    yield s
    s.stop()


def ask(server, method, path, body=None, **headers):
    request = urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {server.token}", **headers}, method=method)
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, json.loads(r.read()), r.headers
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read()), e.headers


def ok(server, method, path, body=None):
    status, out, _ = ask(server, method, path, body)
    assert status == 200, out
    return out


def test_only_with_the_token_and_from_here(server):
    assert ask(server, "GET", "/api/graph", Authorization="Bearer wrong")[0] == 401
    assert ask(server, "GET", "/api/graph", Authorization="")[0] == 401
    assert ask(server, "GET", "/api/graph", Origin="http://evil.example")[0] == 403
    assert ask(server, "GET", "/api/graph", Host="evil.example")[0] == 403
    status, _, headers = ask(server, "GET", f"/api/auth?token={server.token}", Authorization="")
    assert status == 200 and "HttpOnly" in headers["Set-Cookie"]
    assert ask(server, "GET", "/api/graph", Authorization="", Cookie=headers["Set-Cookie"].split(";")[0])[0] == 200


def test_build_run_and_read(server, session, tmp_path):
    assert len(ok(server, "GET", "/api/nodekinds")) >= 49
    assert ok(server, "GET", "/api/nodekinds?kind=ema")[0]["params"]["required"] == ["column"]
    table = ok(server, "POST", "/api/nodes", {"kind": "table", "params": {"table": "df"}})["id"]
    ema = ok(server, "POST", "/api/nodes", {"kind": "ema", "params": {"column": "x", "span": 3}})["id"]
    edge = ok(server, "POST", "/api/edges", {"source": table, "target": ema})["id"]
    assert ask(server, "GET", f"/api/results/{ema}/out")[0] == 409
    assert ok(server, "POST", "/api/run", {"targets": [ema]})["targets"] == [[ema, "out"]]
    session._current.result(60)
    page = ok(server, "GET", f"/api/results/{ema}/out?offset=10&limit=5&columns=time,x_ema_3")
    assert page["total"] == 80 and [r[0] for r in page["rows"]] == [10, 11, 12, 13, 14]
    assert ok(server, "GET", f"/api/summaries/{ema}/out")["summary"]["rows"] == 80
    box = ok(server, "GET", f"/api/diagnostics/{ema}/out/acf?column=x&lags=3")
    assert len(box["data"]["acf"]) == 4
    assert {e["kind"] for e in ok(server, "GET", "/api/events")["events"]} >= {"added", "finished"}
    ok(server, "PATCH", f"/api/nodes/{ema}", {"params": {"column": "x", "span": 5}, "position": [1, 2]})
    graph = ok(server, "GET", "/api/graph")
    assert graph["nodes"][1]["status"] == "idle" and graph["nodes"][1]["position"] == [1, 2] and graph["tables"][0]["name"] == "df"
    assert "ema" in ok(server, "GET", f"/api/export/{ema}")["script"]
    assert ok(server, "PUT", "/api/session", {"path": "kept"}) == {"path": "kept"} == ok(server, "GET", "/api/session")
    ok(server, "DELETE", f"/api/edges/{edge}")
    ok(server, "DELETE", f"/api/nodes/{ema}")
    assert len(ok(server, "POST", "/api/session", {"path": "kept"})["nodes"]) == 2


def test_files_tables_and_contexts(server, tmp_path):
    (tmp_path / "more.csv").write_text("time,y\n1,2.5\n2,3.5\n")
    assert ok(server, "GET", "/api/files") == [{"name": "more.csv", "folder": False}]
    assert ok(server, "POST", "/api/tables/more", {"path": "more.csv"})["columns"] == {"time": "int", "y": "double"}
    assert ask(server, "POST", "/api/tables/bad", {"path": "../../etc/passwd.csv"})[0] == 403
    assert ok(server, "PUT", "/api/contexts/w", {"start": 1, "stop": 3})["w"] == {"start": 1, "stop": 3}
    assert "w" not in ok(server, "DELETE", "/api/contexts/w")
    ok(server, "PUT", "/api/prelude", {"statements": ["create or replace temporary function plus1(v double) returns double return v + 1"]})
    out = ok(server, "POST", "/api/nodes", {"kind": "writecsv", "params": {"path": str(tmp_path / "out")}})["id"]
    ok(server, "POST", "/api/edges", {"source": ok(server, "POST", "/api/nodes", {"kind": "table", "params": {"table": "df"}})["id"], "target": out})
    ok(server, "POST", f"/api/write/{out}", {})
    assert (tmp_path / "out").exists()


def test_errors_have_a_status(server):
    assert ask(server, "GET", "/api/nothing")[0] == 404
    assert ask(server, "DELETE", "/api/graph")[0] == 405
    assert ask(server, "POST", "/api/nodes", {"kind": "nothing"})[0] == 404
    assert ask(server, "POST", "/api/nodes", {"kind": "head", "params": {"n": True}})[0] == 400
    assert ask(server, "POST", "/api/nodes", {"sort": "head"})[0] == 400
    assert ask(server, "DELETE", "/api/contexts/analysis")[0] == 400


def test_agent(session, tmp_path):
    agent = Agent(Commands(session, str(tmp_path)), lambda: "http://here")
    tell = lambda method, **params: agent.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})["result"]

    def call(name, **args):
        out = tell("tools/call", name=name, arguments=args)
        return out["content"][0]["text"] if out["isError"] else json.loads(out["content"][0]["text"])

    assert tell("initialize")["serverInfo"]["name"] == "meridia" and len(tell("tools/list")["tools"]) == 18
    assert agent.handle({"method": "notifications/initialized"}) is None and "error" in agent.handle({"id": 2, "method": "x"})
    table = call("add_node", kind="table", params={"table": "df"})["id"]
    out = call("fit_insample", source=table, params={"family": "ar", "column": "x", "p": 1, "fitcontext": "train"})
    assert out["state"] == "ok" and out["residuals"]["summary"]["insample"]["n"] == 40 and out["residuals"]["summary"]["outofsample"]["n"] == 39 and "data" not in out["residuals"]
    assert math.isfinite(out["residuals"]["summary"]["insample"]["std"])
    before = len(call("get_graph")["nodes"])
    assert "no output" in call("fit_insample", source=table, port="side", params={"family": "ar", "column": "x", "p": 1}) and len(call("get_graph")["nodes"]) == before
    assert call("run", targets=[table])["state"] == "ok" and call("get_result_summary", node=table)["summary"]["rows"] == 80
    assert "data" not in call("get_diagnostic", node=table, kind="adf", column="x")
    assert "no tool" in call("nothing") and "needs node" in call("get_diagnostic", kind="acf") and call("get_web_url") == {"url": "http://here"}
    lines = io.StringIO('{"jsonrpc": "2.0", "id": 5, "method": "ping"}\n\n')
    written = io.StringIO()
    agent.serve(lines, written)
    assert json.loads(written.getvalue()) == {"jsonrpc": "2.0", "id": 5, "result": {}}
