"""What a remote client may ask of a session, as functions of JSON values: the HTTP routes and the agent tools share them.

Frames don't leave as a whole: a page holds ``PAGE_ROWS`` rows at most, and agents get summaries.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from meridia import graph as G
from meridia.functions import diagnostics as D
from meridia.operators import rows
from meridia.session import DIAGNOSTICS, MAIN, Run, Session

PAGE_ROWS = 1000
FILES = (".csv", ".tsv", ".txt", ".parquet")


def plain(value: Any) -> Any:
    """A JSON value: times as ISO text, NaN and infinities as null, bytes by their length."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return f"{len(value)} bytes"
    return D.clean(value)


def moment(value: Any) -> Any:
    """A time as JSON has it: a number, or an ISO date or timestamp."""
    if not isinstance(value, str):
        return value
    return date.fromisoformat(value) if len(value) == 10 else datetime.fromisoformat(value)


def _report(result: D.DiagnosticResult, data: bool = True) -> dict:
    out = {"kind": result.kind, "summary": result.summary, "warnings": result.warnings}
    if result.panels:
        out["panels"] = {n: _report(p, data) for n, p in result.panels.items()}
    return plain(out | ({"data": result.data} if data else {}))


@dataclass(frozen=True)
class Command:
    """A function of the session's commands, with the JSON schema of its arguments."""

    name: str
    doc: str
    call: Callable[..., Any]
    properties: dict[str, dict]
    required: tuple[str, ...] = ()
    readonly: bool = False

    def schema(self) -> dict:
        return {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}

    def check(self, args: dict) -> None:
        unknown, missing = set(args) - set(self.properties), [n for n in self.required if args.get(n) is None]
        if unknown:
            raise ValueError(f"{self.name} has no argument {', '.join(sorted(unknown))}")
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")


class Commands:
    """``folder``: the only place that files are read from and written to; ``wait``: seconds that a run is waited for."""

    def __init__(self, session: Session, folder: str = ".", wait: float = 600.0):
        self.session, self.folder, self.wait = session, os.path.abspath(folder), wait
        self.file: str | None = None

    def _path(self, path: str) -> str:
        full = os.path.abspath(os.path.join(self.folder, path))
        if os.path.commonpath([full, self.folder]) != self.folder:
            raise PermissionError(f"{path} lies outside of the session's folder")
        return full

    def _port(self, node: str, port: str | None) -> str:
        outputs = self.session.graph.kind(node).outputs
        if port and port not in outputs:
            raise KeyError(f"{node} has no output {port!r}")
        return port or outputs[0]

    def _kept(self, node: str, port: str | None, context: str):
        """A result that a run has kept; asking never starts one."""
        s, port = self.session, self._port(node, port)
        df = s.load(node, port, context)
        if not df.storageLevel.useMemory:
            raise LookupError(f"{node} has not been run over {context}")
        return s.pipeline(node, port), df

    # Reading

    def node_kinds(self, kind: str | None = None, category: str | None = None) -> list[dict]:
        out = []
        for k in G.REGISTRY.values():
            if kind in (None, k.name) and category in (None, k.group):
                entry = {"name": k.name, "category": k.group, "doc": (k.call.__doc__ or "").strip().split("\n")[0], "inputs": [vars(p) for p in k.inputs], "outputs": list(k.outputs), "acausal": list(k.acausal)}
                out.append(entry | ({"params": k.schema(), "order": list(k.params)} if kind or category else {}))
        if not out:
            raise KeyError("no such kind or category")
        return out

    def graph(self) -> dict:
        s = self.session
        tainted, run = s.graph.tainted(), s._current
        nodes = []
        for n in s.graph.nodes.values():
            state = {"status": s.status.get(n.id, "idle"), "error": s.errors.get(n.id), "acausal": [o for o in s.graph.kind(n.id).outputs if (n.id, o) in tainted]}
            nodes.append({"id": n.id, "kind": n.kind, "params": n.params, "position": list(n.position)} | state)
        running = {"targets": run.targets, "done": len(run.frames)} if run is not None and run.thread.is_alive() else None
        return plain({"nodes": nodes, "edges": [vars(e) for e in s.graph.edges.values()], "contexts": self.contexts(), "tables": self.tables(), "prelude": s.prelude, "run": running})

    def contexts(self) -> dict:
        return plain({n: {"start": c.start, "stop": c.stop} for n, c in self.session.contexts.items()})

    def tables(self) -> list[dict]:
        return [{"name": n, "columns": dict(t.df.dtypes), "time": t.time, "frozen": t.within is not None} for n, t in self.session.tables.items()]

    def result(self, node: str, port: str | None = None, context: str = MAIN, offset: int = 0, limit: int = 100, columns: list[str] | None = None, key: str | None = None) -> dict:
        p, df = self._kept(node, port, context)
        df = D.keyed(df, key)
        total = df.count()
        shown = rows.page(p, df, int(offset), min(int(limit), PAGE_ROWS))
        if columns:
            shown = shown.select(*columns)
        return {"columns": shown.dtypes, "rows": [plain(list(r)) for r in shown.collect()], "total": total}

    def summary(self, node: str, port: str | None = None, context: str = MAIN, columns: list[str] | None = None, key: str | None = None) -> dict:
        p, df = self._kept(node, port, context)
        return _report(D.result_summary(p, df, columns=columns, key=key))

    def diagnostic(self, node: str, kind: str, column: str | None = None, port: str | None = None, context: str = MAIN, key: str | None = None, data: bool = True, **options: Any) -> dict:
        p, df = self._kept(node, port, context)
        if kind == "summary":
            return _report(D.result_summary(p, df, key=key), data)
        if kind == "fit":
            return _report(D.fit_report(D.keyed(df, key), column or "model"), data)
        if kind not in DIAGNOSTICS:
            raise KeyError(f"a diagnostic is one of {', '.join([*DIAGNOSTICS, 'summary', 'fit'])}")
        if column is None:
            raise ValueError("a diagnostic needs a column")
        return _report(self.session.diagnostic(node, kind, column, self._port(node, port), context, key, **options), data)

    def files(self, path: str = ".") -> list[dict]:
        full, out = self._path(path), []
        for name in sorted(os.listdir(full)):
            here = os.path.join(full, name)
            if name.endswith(FILES) or os.path.isdir(here):
                out.append({"name": name, "folder": os.path.isdir(here) and not name.endswith(".parquet")})
        return out

    # Edits

    def add_node(self, kind: str, params: dict | None = None, position: list | None = None) -> dict:
        return {"id": self.session.add_node(kind, params or {}, tuple(position or (0.0, 0.0)))}

    def update_node(self, id: str, params: dict | None = None, position: list | None = None) -> dict:
        self.session.graph.node(id)
        if params is not None:
            self.session.set_params(id, params)
        if position is not None:
            self.session.set_position(id, *position)
        return {"id": id}

    def remove_node(self, id: str) -> dict:
        self.session.remove_node(id)
        return {"id": id}

    def connect(self, source: str, target: str, input: str = "in", output: str | None = None) -> dict:
        return {"id": self.session.connect(source, target, input, output)}

    def disconnect(self, id: str) -> dict:
        self.session.disconnect(id)
        return {"id": id}

    def set_context(self, name: str, start: Any, stop: Any) -> dict:
        self.session.set_context(name, moment(start), moment(stop))
        return self.contexts()

    def remove_context(self, name: str) -> dict:
        self.session.remove_context(name)
        return self.contexts()

    def load_table(self, name: str, path: str, time: str | None = "time") -> dict:
        self.session.load_table(name, self._path(path), time)
        return {"name": name, "columns": dict(self.session.tables[name].df.dtypes)}

    def set_prelude(self, statements: list[str]) -> dict:
        self.session.set_prelude(statements)
        return {"prelude": self.session.prelude}

    def freeze(self, id: str, name: str, port: str | None = None, context: str = MAIN) -> dict:
        return {"id": self.session.freeze(id, name, self._path("frozen"), self._port(id, port), context)}

    # Runs

    def start(self, targets: list, context: str = MAIN) -> dict:
        run = self.session.run(*[t if isinstance(t, str) else tuple(t) for t in targets], context=context)
        return plain({"targets": run.targets, "context": context})

    def _waited(self, run: Run) -> dict:
        run.thread.join(self.wait)
        state = "running" if run.thread.is_alive() else "error" if run.error is not None else "ok"
        nodes = {n: {"status": self.session.status.get(n), "error": self.session.errors.get(n)} for n in self.session.graph.nodes}
        return {"state": state, "error": str(run.error) if run.error else None, "nodes": {n: v for n, v in nodes.items() if v["status"] != "idle"}}

    def run(self, targets: list, context: str = MAIN) -> dict:
        return self._waited(self.session.run(*[t if isinstance(t, str) else tuple(t) for t in targets], context=context))

    def cancel(self) -> dict:
        self.session.cancel()
        return {"ok": True}

    def write(self, id: str, context: str = MAIN, mode: str = "errorifexists") -> dict:
        self._path(self.session.graph.node(id).params["path"])
        self.session.write(id, context, mode)
        return {"id": id}

    def fit_insample(self, source: str, params: dict, port: str | None = None, context: str = MAIN, position: list | None = None) -> dict:
        """Propose a fit: it stays in the graph when it can be connected, and its residuals are told."""
        if "column" not in params and "response" not in params:
            raise ValueError("a fit needs the column that it is fitted to")
        node = self.session.add_node("fit", params, tuple(position or (0.0, 0.0)))
        try:
            self.session.connect(source, node, "in", self._port(source, port))
        except Exception:
            self.session.remove_node(node)
            raise
        out = {"id": node} | self.run([[node, "insample"]], context)
        if out["state"] == "ok":
            out["residuals"] = self.diagnostic(node, "residuals", params.get("column") or params["response"], "insample", context, data=False)
        return out

    # Files of the session

    def export(self, node: str, output: str | None = None, context: str = MAIN) -> dict:
        return {"script": self.session.export(node, output, context)}

    def session_file(self) -> dict:
        return {"path": self.file}

    def save(self, path: str | None = None) -> dict:
        if not (path or self.file):
            raise ValueError("give a path: the session has none yet")
        full = self._path(path or self.file)
        self.session.save(full)
        self.file = os.path.relpath(full, self.folder)
        return self.session_file()

    def open(self, path: str) -> dict:
        full = self._path(path)
        self.session.open(full)
        self.file = os.path.relpath(full, self.folder)
        return self.graph()


_T = {"type": "string"}
_CONTEXT = {"context": {"type": "string", "description": "a named window", "default": MAIN}}
_AT = {"node": _T, "port": {"type": "string", "description": "an output; the first by default"}}
_POSITION = {"position": {"type": "array", "items": {"type": "number"}}}
_TARGETS = {"targets": {"type": "array", "description": "nodes, or [node, output] pairs"}}
_LIST = {"type": "array", "items": _T}


def _command(name: str, doc: str, properties: dict | None = None, required: tuple[str, ...] = (), readonly: bool = False) -> Command:
    return Command(name, doc, getattr(Commands, name), properties or {}, required, readonly)


#: By the name of the method that answers.
COMMANDS = {c.name: c for c in (
    _command("node_kinds", "The kinds of nodes; with a kind or category, the JSON schema of their parameters too.", {"kind": _T, "category": _T}, readonly=True),
    _command("graph", "Nodes with status, errors and what looks ahead, edges, contexts, tables, prelude and the run under way.", readonly=True),
    _command("contexts", "The named windows.", readonly=True),
    _command("tables", "The session's tables.", readonly=True),
    _command("result", "A page of rows of a result.", _AT | _CONTEXT | {"offset": {"type": "integer"}, "limit": {"type": "integer", "maximum": PAGE_ROWS}, "columns": _LIST, "key": _T}, ("node",), True),
    _command("summary", "Columns, head and tail of a result.", _AT | _CONTEXT | {"columns": _LIST, "key": _T}, ("node",), True),
    _command("diagnostic", "An analysis of a result's column.", _AT | _CONTEXT | {"kind": _T, "column": _T, "key": _T, "lags": {}, "level": {"type": "number"}, "maxpoints": {"type": "integer"}, "bins": {"type": "integer"}, "dof": {"type": "integer"}, "lag": {"type": "integer"}, "deterministic": _T, "demean": {"type": "boolean"}}, ("node", "kind"), True),
    _command("files", "Tables that can be loaded from a folder.", {"path": _T}, readonly=True),
    _command("add_node", "Add a node.", {"kind": _T, "params": {"type": "object"}} | _POSITION, ("kind",)),
    _command("update_node", "Set a node's parameters or position.", {"id": _T, "params": {"type": "object"}} | _POSITION, ("id",)),
    _command("remove_node", "Remove a node with its edges.", {"id": _T}, ("id",)),
    _command("connect", "Connect an output to an input.", {"source": _T, "target": _T, "input": _T, "output": _T}, ("source", "target")),
    _command("disconnect", "Remove an edge.", {"id": _T}, ("id",)),
    _command("set_context", "Add or change a named window.", {"name": _T, "start": {}, "stop": {}}, ("name", "start", "stop")),
    _command("remove_context", "Remove a named window.", {"name": _T}, ("name",)),
    _command("load_table", "Load a CSV or Parquet file as a table; without time it is only looked up.", {"name": _T, "path": _T, "time": {"type": ["string", "null"]}}, ("name", "path")),
    _command("set_prelude", "Replace the SQL functions that expressions may use.", {"statements": _LIST}, ("statements",)),
    _command("freeze", "Keep a result as a table.", {"id": _T, "name": _T, "port": _T} | _CONTEXT, ("id", "name")),
    _command("start", "Start a run.", _TARGETS | _CONTEXT, ("targets",)),
    _command("run", "Run and wait; tells each node's state.", _TARGETS | _CONTEXT, ("targets",)),
    _command("cancel", "Cancel the run under way."),
    _command("write", "Let a writing node write.", {"id": _T, "mode": _T} | _CONTEXT, ("id",)),
    _command("fit_insample", "Add a fit behind a node, run it and tell its residuals.", {"source": _T, "params": {"type": "object"}, "port": _T} | _CONTEXT | _POSITION, ("source", "params")),
    _command("export", "A script that gives a node's result.", {"node": _T, "output": _T} | _CONTEXT, ("node",), True),
    _command("session_file", "Where the session was last saved.", readonly=True),
    _command("save", "Save the session.", {"path": _T}),
    _command("open", "Open a saved session in place of this one.", {"path": _T}, ("path",)),
)}


def ask(commands: Commands, name: str, args: dict | None = None) -> Any:
    command = COMMANDS[name]
    command.check(args or {})
    return command.call(commands, **(args or {}))
