"""Graphs of operator nodes.  A kind is declared once, as the call of an operator function; the same declaration
checks parameters, builds pipelines and prints the script that builds them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from meridia import sources as src
from meridia.functions import summarizers as S
from meridia.operators import joins, rows, summarize, timeseries
from meridia.pipeline import Pipeline, like
from meridia.span import Span

REQUIRED = object()
OFFSET_UNITS = ("weeks", "days", "hours", "minutes", "seconds", "milliseconds", "microseconds")


class ParameterError(ValueError):
    pass


class NodeError(RuntimeError):
    """An error with the innermost node that it came from."""

    def __init__(self, node: str, message: str):
        super().__init__(f"{node}: {message}")
        self.node, self.message = node, message


@dataclass
class Env:
    """What parameters may name: the session's tables, contexts and model objects."""

    spark: Any
    tables: dict[str, Any] = field(default_factory=dict)
    contexts: dict[str, Span] = field(default_factory=dict)
    models: dict[str, Any] = field(default_factory=dict)


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _texts(v: Any) -> bool:
    return isinstance(v, str) or (isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v))


def _offset(v: Any) -> bool:
    return _number(v) or (isinstance(v, dict) and bool(v) and all(u in OFFSET_UNITS and _number(x) for u, x in v.items()))


def _entries(v: Any) -> bool:
    return isinstance(v, list) and all(isinstance(e, dict) and e.get("summarizer") in S.REGISTRY and set(e) <= {"summarizer", "columns", "options"} for e in v)


#: Kinds of parameters: the check of a value, and its JSON schema.
PARAM_KINDS: dict[str, tuple[Callable[[Any], bool], dict]] = {
    "string": (lambda v: isinstance(v, str), {"type": "string"}),
    "expression": (lambda v: isinstance(v, str), {"type": "string", "description": "a Spark SQL expression"}),
    "integer": (_whole, {"type": "integer"}),
    "number": (_number, {"type": "number"}),
    "boolean": (lambda v: isinstance(v, bool), {"type": "boolean"}),
    "names": (_texts, {"type": ["string", "array"], "items": {"type": "string"}}),
    "integers": (lambda v: isinstance(v, (list, tuple)) and all(map(_whole, v)), {"type": "array", "items": {"type": "integer"}}),
    "offset": (_offset, {"type": ["number", "object"], "description": "a number, or parts such as {\"days\": 1}"}),
    "offsets": (lambda v: isinstance(v, dict) and all(map(_offset, v.values())), {"type": "object"}),
    "expressions": (lambda v: isinstance(v, dict) and all(isinstance(x, str) for x in v.values()), {"type": "object", "additionalProperties": {"type": "string"}}),
    "values": (lambda v: isinstance(v, dict), {"type": "object"}),
    "rows": (lambda v: isinstance(v, list) and all(isinstance(x, dict) for x in v), {"type": "array", "items": {"type": "object"}}),
    "summarizers": (_entries, {"type": "array", "items": {"type": "object", "required": ["summarizer"]}}),
    "summarizer": (lambda v: _entries([v]), {"type": "object", "required": ["summarizer"]}),
    "table": (lambda v: isinstance(v, str), {"type": "string", "description": "a table of the session"}),
    "context": (lambda v: isinstance(v, str), {"type": "string", "description": "a context of the session"}),
    "model": (lambda v: isinstance(v, str), {"type": "string", "description": "a model object of the session"}),
}
NAMED = {"table": "tables", "context": "contexts", "model": "models"}


@dataclass(frozen=True)
class Param:
    kind: str
    default: Any = None
    choices: tuple = ()

    @property
    def required(self) -> bool:
        return self.default is REQUIRED

    def check(self, name: str, value: Any) -> None:
        if value is None and not self.required:
            return
        if not PARAM_KINDS[self.kind][0](value):
            raise ParameterError(f"{name} is no valid {self.kind}")
        if self.choices and value not in self.choices:
            raise ParameterError(f"{name} is one of {', '.join(map(str, self.choices))}")

    def schema(self) -> dict:
        out = dict(PARAM_KINDS[self.kind][1])
        if self.choices:
            out["enum"] = list(self.choices)
        if not self.required and self.default is not None:
            out["default"] = self.default
        return out

    def value(self, v: Any, env: Env) -> Any:
        if v is None:
            return None
        if self.kind in NAMED:
            known = getattr(env, NAMED[self.kind])
            if v not in known:
                raise ParameterError(f"the session has no {self.kind} {v!r}")
            return known[v]
        if self.kind == "rows":
            return env.spark.createDataFrame(v)
        if self.kind == "offset":
            return timedelta(**v) if isinstance(v, dict) else v
        if self.kind == "offsets":
            return {k: timedelta(**x) if isinstance(x, dict) else x for k, x in v.items()}
        if self.kind == "summarizers":
            return [_summarizer(e, env) for e in v]
        if self.kind == "summarizer":
            return _summarizer(v, env)
        return _plainly(self.kind, v)

    def code(self, v: Any) -> str:
        """The value as Python source."""
        if v is None:
            return "None"
        if self.kind in NAMED:
            return f"{NAMED[self.kind].upper()}[{v!r}]"
        if self.kind == "rows":
            return f"spark.createDataFrame({v!r})"
        if self.kind == "offset":
            return _offset_code(v)
        if self.kind == "offsets":
            return "{" + ", ".join(f"{k!r}: {_offset_code(x)}" for k, x in v.items()) + "}"
        if self.kind == "summarizers":
            return "[" + ", ".join(map(_summarizer_code, v)) + "]"
        if self.kind == "summarizer":
            return _summarizer_code(v)
        return repr(_plainly(self.kind, v))


def _plainly(kind: str, v: Any) -> Any:
    if kind == "names":
        return [v] if isinstance(v, str) else list(v)
    return tuple(v) if kind == "integers" else v


def _offset_code(v: Any) -> str:
    return f"timedelta({', '.join(f'{u}={x!r}' for u, x in v.items())})" if isinstance(v, dict) else repr(v)


def _summarizer_parts(e: dict) -> tuple[list, dict]:
    columns = e.get("columns", [])
    return ([columns] if isinstance(columns, str) else list(columns)), {k: timedelta(**v) if isinstance(v, dict) else v for k, v in e.get("options", {}).items()}


def _summarizer(e: dict, env: Env) -> S.Summarizer:
    columns, options = _summarizer_parts(e)
    if "model" in options:  # a model object of the session
        if options["model"] not in env.models:
            raise ParameterError(f"the session has no model {options['model']!r}")
        options["model"] = env.models[options["model"]]
    return S.REGISTRY[e["summarizer"]](*columns, **options)


def _summarizer_code(e: dict) -> str:
    columns = e.get("columns", [])
    args = [repr(c) for c in ([columns] if isinstance(columns, str) else columns)]
    return f"S.{e['summarizer']}({', '.join(args + [f'{k}=' + (f'MODELS[{v!r}]' if k == 'model' else _offset_code(v) if k == 'halflife' else repr(v)) for k, v in e.get('options', {}).items()])})"


@dataclass(frozen=True)
class Port:
    name: str
    many: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Kind:
    """``args``: parameters or other ports given by position (``spark`` is the session); ``star`` and ``spread``:
    the list and the mapping that are unpacked; everything else goes by ``keywords`` (parameter -> argument)."""

    name: str
    group: str
    call: Callable
    inputs: tuple[Port, ...]
    params: dict[str, Param]
    args: tuple[str, ...] = ()
    star: str | None = None
    spread: str | None = None
    keywords: dict[str, str] = field(default_factory=dict)
    outputs: tuple[str, ...] = ("out",)
    acausal: tuple[str, ...] = ()

    @property
    def step(self) -> bool:
        return any(p.name == "in" for p in self.inputs)

    def check(self, params: dict, complete: bool) -> None:
        """Types at an edit; at a build required parameters must be there too."""
        for name, value in params.items():
            if name not in self.params:
                raise ParameterError(f"{self.name} has no parameter {name!r}")
            self.params[name].check(name, value)
        missing = [n for n, p in self.params.items() if p.required and params.get(n) is None]
        if complete and missing:
            raise ParameterError(f"{self.name} needs {', '.join(missing)}")

    def schema(self) -> dict:
        return {"type": "object", "properties": {n: p.schema() for n, p in self.params.items()}, "required": [n for n, p in self.params.items() if p.required], "additionalProperties": False}

    def _given(self, params: dict) -> dict[str, Any]:
        return {n: v for n, p in self.params.items() if (v := params.get(n, None if p.required else p.default)) is not None}

    def build(self, env: Env, inputs: dict[str, list[Pipeline]], params: dict) -> dict[str, Pipeline]:
        given = {n: self.params[n].value(v, env) for n, v in self._given(params).items()}
        ports = {p.name: (inputs[p.name] if p.many else inputs[p.name][0]) for p in self.inputs if inputs.get(p.name)}
        everything = {"spark": env.spark} | ports | given
        args = [everything[a] for a in self.args]
        if self.star:
            args += everything.get(self.star, ())
        named = {k: everything[n] for n, k in self.keywords.items() if n in everything}
        made = self.call(*args, **named, **(given.get(self.spread, {}) if self.spread else {}))
        if not isinstance(made, dict):
            made = {self.outputs[0]: made}
        return {o: ports["in"] | m if self.step else m for o, m in made.items()}

    def emit(self, inputs: dict[str, list[str]], params: dict) -> dict[str, str]:
        """The source text of every output, given the variables of the inputs."""
        given = {n: self.params[n].code(v) for n, v in self._given(params).items()}
        ports = {p.name: (f"[{', '.join(inputs[p.name])}]" if p.many else inputs[p.name][0]) for p in self.inputs if inputs.get(p.name)}
        everything = {"spark": "spark"} | ports | given
        args = [everything[a] for a in self.args]
        if self.star in everything:
            args.append(f"*{everything[self.star]}")
        args += [f"{k}={everything[n]}" for n, k in self.keywords.items() if n in everything]
        if self.spread in given:
            args.append(f"**{given[self.spread]}")
        module = self.call.__module__.rsplit(".", 1)[-1]
        text = f"{module}.{self.call.__name__}({', '.join(args)})"
        return {o: (f"{ports['in']} | " if self.step else "") + text + (f"[{o!r}]" if len(self.outputs) > 1 else "") for o in self.outputs}


REGISTRY: dict[str, Kind] = {}


def register(kind: Kind) -> Kind:
    """Add a kind of one's own; names are taken once."""
    if kind.name in REGISTRY:
        raise ValueError(f"the kind {kind.name} exists")
    unknown = (set(kind.args) | set(kind.keywords)) - set(kind.params) - {p.name for p in kind.inputs} - {"spark"}
    if unknown:
        raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
    REGISTRY[kind.name] = kind
    return kind


IN = Port("in")


def _kind(name: str, group: str, call: Callable, params: dict[str, Param], args=(), ports=(IN,), star=None, spread=None, renamed=None, **more: Any) -> None:
    used = {*args, star, spread}
    keywords = {n: (renamed or {}).get(n, n) for n in params if n not in used} | {n: k for n, k in (renamed or {}).items() if n not in params}
    register(Kind(name, group, call, tuple(ports), params, tuple(args), star, spread, keywords, **more))


def _p(kind: str, default: Any = None, *choices: Any) -> Param:
    return Param(kind, default, choices)


KEY, NEED = _p("names"), REQUIRED
_READ = {"time": _p("string", "time"), "order": _p("names", ()), "closed": _p("boolean", False)}
_ASOF = {"key": KEY, "tolerance": _p("offset"), "strict": _p("boolean", False), "leftprefix": _p("string"), "rightprefix": _p("string"), "righttime": _p("string"), "splitkeys": _p("boolean", False)}
_ASOF_NAMES = {"splitkeys": "split_keys", "leftprefix": "left_prefix", "rightprefix": "right_prefix", "righttime": "right_time"}
_ORDERS = {"order": _p("integers", (1, 0, 0)), "seasonal_order": _p("integers", (0, 0, 0, 0)), "include_mean": _p("boolean", False)}
_SELECT = {"columns": _p("names", ()), "match": _p("string")}
_SS = _p("summarizers", NEED)
_PATH = {"path": _p("string", NEED)}
_OPERATION = _p("string", "predict", "predict", "predict_mean", "predict_mode", "predict_median")

_kind("emptyframe", "source", src.empty_frame, {"schema": _p("string", "time bigint")}, ("spark", "schema"), ())
_kind("clock", "source", src.clock, {"interval": _p("offset", NEED)}, ("spark", "interval"), ())
_kind("concatenate", "source", src.concatenate, {}, (), (Port("parts", many=True),), star="parts")
_kind("merge", "source", src.merge, {}, (), (Port("parts", many=True),), star="parts")
_kind("table", "source", src.stored, {"table": _p("table", NEED), "time": _p("string"), "order": _p("names"), "closed": _p("boolean"), "checkorder": _p("boolean", False)}, ("table",), (), renamed={"checkorder": "check"})
_kind("readcsv", "file", src.read_csv, _PATH | _READ | {"types": _p("values"), "rename": _p("values"), "delim": _p("string")}, ("spark", "path"), ())
for _name in ("readparquet", "readjls"):
    _kind(_name, "file", src.read_parquet, _PATH | _READ | {"rename": _p("values")}, ("spark", "path"), ())
_kind("writecsv", "file", src.write_csv, _PATH, ("path",))
for _name in ("writeparquet", "writejls"):
    _kind(_name, "file", src.write_parquet, _PATH, ("path",))
_kind("filterrows", "rows", rows.filter_rows, {"predicate": _p("expression", NEED)}, ("predicate",))
_kind("addcolumns", "rows", rows.add_columns, {"columns": _p("expressions", NEED)}, spread="columns")
_kind("selectcolumns", "rows", rows.select_columns, _SELECT, star="columns")
_kind("dropcolumns", "rows", rows.drop_columns, _SELECT, star="columns")
_kind("reordercolumns", "rows", rows.reorder_columns, _SELECT, star="columns")
_kind("lag", "rows", rows.lag, {"offset": _p("offset", NEED)}, ("offset",))
_kind("head", "rows", rows.head, {"n": _p("integer", NEED)}, ("n",))
_kind("settime", "rows", rows.set_time, {"spec": _p("expression", NEED)}, ("spec",))
_kind("lastrow", "rows", rows.last_row, {"key": KEY})
_kind("sortcycles", "rows", rows.sort_cycles, {"by": _p("names", NEED), "rev": _p("boolean", False)}, star="by")
_kind("forwardfill", "rows", rows.forward_fill, {"columns": _p("names", NEED), "key": KEY, "tolerance": _p("offset"), "splitkeys": _p("boolean", False)}, star="columns", renamed={"splitkeys": "split_keys"})
_kind("fillmissing", "rows", rows.fill_missing, {"values": _p("values", NEED)}, spread="values")
_kind("summarize", "summarize", summarize.summarize, {"summarizers": _SS, "key": KEY}, star="summarizers")
_kind("summarizecycles", "summarize", summarize.summarize_cycles, {"summarizers": _SS, "key": KEY, "keyset": _p("rows")}, star="summarizers")
_kind("addsummarycolumns", "summarize", summarize.add_summary_columns, {"summarizers": _SS, "key": KEY}, star="summarizers")
_kind("addrollingcolumns", "summarize", summarize.add_rolling_columns, {"windows": _p("offsets", NEED), "summarizers": _SS, "key": KEY}, ("windows",), (IN, Port("from", optional=True)), star="summarizers", renamed={"from": "source"})
_kind("intervalize", "summarize", summarize.intervalize, {"summarizers": _SS, "key": KEY, "keyset": _p("rows"), "closelast": _p("boolean", False)}, ("clock",), (Port("clock"), IN), star="summarizers")
_kind("summarizewindows", "summarize", summarize.summarize_windows, {"lookback": _p("offset", NEED), "summarizers": _SS, "key": KEY, "keyset": _p("rows"), "interval": _p("offset")}, ("clock", "lookback"), (Port("clock"), IN), star="summarizers")
_kind("asofjoin", "join", joins.asof_join, _ASOF, ("right",), (IN, Port("right")), renamed=_ASOF_NAMES)
_kind("lookupjoin", "join", joins.lookup_in, {"table": _p("table", NEED), "key": _p("names", NEED), "unmatched": _p("string", "missing", "missing", "error", "drop"), "leftprefix": _p("string"), "rightprefix": _p("string")}, ("table", "key"), renamed={"leftprefix": "left_prefix", "rightprefix": "right_prefix"})
_kind("futurejoin", "acausal", joins.future_join, _ASOF, ("right",), (IN, Port("right")), renamed=_ASOF_NAMES, acausal=("out",))
_kind("lead", "acausal", rows.lead, {"offset": _p("offset", NEED)}, ("offset",), acausal=("out",))
_kind("acausal_settime", "acausal", rows.acausal_set_time, {"spec": _p("expression", NEED)}, ("spec",), acausal=("out",))
_kind("lags", "timeseries", timeseries.lags, {"column": _p("string", NEED), "p": _p("integer", NEED), "key": KEY, "name": _p("string")}, ("column", "p"))
_kind("difference", "timeseries", timeseries.difference, {"column": _p("string", NEED), "order": _p("integer", 1), "lag": _p("integer", 1), "key": KEY, "name": _p("string")}, ("column",))
_kind("logtransform", "timeseries", timeseries.log_transform, {"column": _p("string", NEED), "name": _p("string")}, ("column",))
_kind("boxcox", "timeseries", timeseries.box_cox, {"column": _p("string", NEED), "lambda": _p("number", NEED), "name": _p("string")}, ("column", "lambda"))
_kind("ema", "timeseries", timeseries.ema, {"column": _p("string", NEED), "span": _p("number"), "halflife": _p("offset"), "key": KEY, "name": _p("string"), "splitkeys": _p("boolean", False)}, ("column",), renamed={"splitkeys": "split_keys"})
_kind("macd", "timeseries", timeseries.macd, {"column": _p("string", NEED), "fast": _p("integer", 12), "slow": _p("integer", 26), "signal": _p("integer", 9), "name": _p("string", "macd"), "key": KEY, "splitkeys": _p("boolean", False)}, ("column",), renamed={"splitkeys": "split_keys"})
_kind("ar", "timeseries", timeseries.ar, {"column": _p("string", NEED), "p": _p("integer", NEED), "key": KEY, "name": _p("string", "ar")}, ("column", "p"))
_kind("fitarma", "timeseries", timeseries.fit_arma, {"column": _p("string", NEED), **_ORDERS, "name": _p("string", "model"), "key": KEY}, ("column",))
_kind("applyarma", "timeseries", timeseries.apply_arma, {"column": _p("string", NEED), "modelcolumn": _p("string", "model"), "key": KEY, "tolerance": _p("offset"), "strict": _p("boolean", False), "horizon": _p("integer", 0), "name": _p("string")}, ("models", "column"), (IN, Port("models")), renamed={"modelcolumn": "column"})
_kind("arma", "timeseries", timeseries.arma, {"lookback": _p("offset", NEED), "column": _p("string", NEED), **_ORDERS, "key": KEY, "horizon": _p("integer", 0), "name": _p("string")}, ("clock", "lookback", "column"), (Port("clock"), IN))
_kind("fitonce", "model", timeseries.fit_once, {"context": _p("context", NEED), "summarizer": _p("summarizer", NEED), "key": KEY}, ("context", "summarizer"))
_kind("fit", "model", timeseries.fit, {"family": _p("string", NEED), "column": _p("string"), **_ORDERS, "p": _p("integer"), "model": _p("model"), "predictors": _p("names"), "response": _p("string"), "fitcontext": _p("context"), "key": KEY}, ("family",), renamed={"fitcontext": "fit_context"}, outputs=("model", "insample"), acausal=("insample",))
_kind("applymodels", "model", timeseries.apply_models, {"predictors": _p("names", NEED), "column": _p("string", "model"), "key": KEY, "tolerance": _p("offset"), "strict": _p("boolean", False), "name": _p("string", "prediction"), "operation": _OPERATION}, ("models", "predictors"), (IN, Port("models")))
_kind("addpredictions", "model", timeseries.add_predictions, {"lookback": _p("offset", NEED), "model": _p("model", NEED), "predictors": _p("names", NEED), "response": _p("string", NEED), "key": KEY, "name": _p("string", "prediction"), "operation": _OPERATION}, ("clock", "lookback", "model", "predictors", "response"), (Port("clock"), IN))
_kind("modelreports", "model", timeseries.model_reports, {"column": _p("string", "model"), "name": _p("string", "report")})


@dataclass
class Node:
    id: str
    kind: str
    params: dict
    position: tuple[float, float] = (0.0, 0.0)


@dataclass(frozen=True)
class Edge:
    id: str
    source: str
    output: str
    target: str
    input: str


class Graph:
    """Nodes and edges; ids are never given twice."""

    def __init__(self):
        self.nodes: dict[str, Node] = {}
        self.edges: dict[str, Edge] = {}
        self.given = {"n": 0, "e": 0}

    def _id(self, letter: str) -> str:
        self.given[letter] += 1
        return f"{letter}{self.given[letter]}"

    def kind(self, node: str) -> Kind:
        return REGISTRY[self.node(node).kind]

    def node(self, node: str) -> Node:
        if node not in self.nodes:
            raise KeyError(f"no node {node}")
        return self.nodes[node]

    def add(self, kind: str, params: dict | None = None, position: tuple[float, float] = (0.0, 0.0)) -> str:
        if kind not in REGISTRY:
            raise KeyError(f"no kind {kind}")
        REGISTRY[kind].check(params or {}, complete=False)
        node = Node(self._id("n"), kind, dict(params or {}), position)
        self.nodes[node.id] = node
        return node.id

    def set_params(self, node: str, params: dict) -> None:
        self.kind(node).check(params, complete=False)
        self.nodes[node].params = dict(params)

    def set_position(self, node: str, x: float, y: float) -> None:
        self.node(node).position = (x, y)

    def remove(self, node: str) -> None:
        self.node(node)
        self.edges = {i: e for i, e in self.edges.items() if node not in (e.source, e.target)}
        del self.nodes[node]

    def connect(self, source: str, target: str, input: str = "in", output: str | None = None) -> str:
        made, takes = self.kind(source), self.kind(target)
        output = output or made.outputs[0]
        port = next((p for p in takes.inputs if p.name == input), None)
        if output not in made.outputs:
            raise ValueError(f"{source} has no output {output!r}")
        if port is None:
            raise ValueError(f"{target} has no input {input!r}")
        if source == target or target in self.ancestors(source):
            raise ValueError("the edge would close a cycle")
        if not port.many and any(e.input == input for e in self.in_edges(target)):
            raise ValueError(f"the input {input!r} of {target} is taken")
        edge = Edge(self._id("e"), source, output, target, input)
        self.edges[edge.id] = edge
        return edge.id

    def disconnect(self, edge: str) -> Edge:
        return self.edges.pop(edge)

    def in_edges(self, node: str) -> list[Edge]:
        return [e for e in self.edges.values() if e.target == node]

    def out_edges(self, node: str) -> list[Edge]:
        return [e for e in self.edges.values() if e.source == node]

    def _reach(self, node: str, step: Callable[[str], list[str]]) -> set[str]:
        found, todo = set(), [node]
        while todo:
            for other in step(todo.pop()):
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return found

    def ancestors(self, node: str) -> set[str]:
        return self._reach(node, lambda n: [e.source for e in self.in_edges(n)])

    def descendants(self, node: str) -> set[str]:
        return self._reach(node, lambda n: [e.target for e in self.out_edges(n)])

    def topological(self) -> list[str]:
        """Sources first; ties in the order of insertion."""
        left, out = dict.fromkeys(self.nodes), []
        while left:
            ready = next(n for n in left if not any(e.source in left for e in self.in_edges(n)))
            out.append(ready)
            del left[ready]
        return out

    def tainted(self) -> set[tuple[str, str]]:
        """The outputs that look ahead, or stand on one that does."""
        out: set[tuple[str, str]] = set()
        for n in self.topological():
            below = any((e.source, e.output) in out for e in self.in_edges(n))
            out |= {(n, o) for o in self.kind(n).outputs if below or o in self.kind(n).acausal}
        return out

    def ready(self, node: str) -> None:
        kind = self.kind(node)
        try:
            kind.check(self.nodes[node].params, complete=True)
        except ParameterError as e:
            raise NodeError(node, str(e)) from e
        joined = {e.input for e in self.in_edges(node)}
        lacking = [p.name for p in kind.inputs if not p.optional and p.name not in joined]
        if lacking:
            raise NodeError(node, f"nothing is connected to {', '.join(lacking)}")

    def compile(self, env: Env, node: str, output: str | None = None, wrap: Callable[[str, str, Pipeline], Pipeline] = lambda n, o, p: p) -> Pipeline:
        """The pipeline of an output; ``wrap`` may put a kept result in its place."""
        made: dict[str, dict[str, Pipeline]] = {}
        needed = self.ancestors(node) | {node}
        for n in self.topological():
            if n not in needed:
                continue
            self.ready(n)
            inputs: dict[str, list[Pipeline]] = {}
            for e in self.in_edges(n):
                inputs.setdefault(e.input, []).append(made[e.source][e.output])
            try:
                built = self.kind(n).build(env, inputs, self.nodes[n].params)
            except Exception as error:
                raise NodeError(n, str(error)) from error
            made[n] = {o: wrap(n, o, _tagged(n, p)) for o, p in built.items()}
        return made[node][output or self.kind(node).outputs[0]]

    def script(self, node: str, output: str | None = None) -> list[str]:
        """Assignments that build an output; the last names it ``result``."""
        lines, needed = [], self.ancestors(node) | {node}
        for n in self.topological():
            if n not in needed:
                continue
            self.ready(n)
            inputs: dict[str, list[str]] = {}
            for e in self.in_edges(n):
                inputs.setdefault(e.input, []).append(_variable(e.source, e.output))
            wanted = {e.output for e in self.out_edges(n) if e.target in needed} | ({output or self.kind(n).outputs[0]} if n == node else set())
            texts = self.kind(n).emit(inputs, self.nodes[n].params)
            lines += [f"{_variable(n, o)} = {t}" for o, t in texts.items() if o in wanted]
        return [*lines, f"result = {_variable(node, output or self.kind(node).outputs[0])}"]

    def to_dict(self) -> dict:
        return {
            "nodes": [{"id": n.id, "kind": n.kind, "params": n.params, "position": list(n.position)} for n in self.nodes.values()],
            "edges": [vars(e) for e in self.edges.values()],
            "given": dict(self.given),
        }

    @classmethod
    def from_dict(cls, data: dict) -> Graph:
        """Checked as edits are; kept ids stay."""
        g = cls()
        for n in data["nodes"]:
            if n["kind"] not in REGISTRY or not re.fullmatch(r"n\d+", n["id"]) or n["id"] in g.nodes:
                raise ValueError(f"the node {n['id']} can't be read")
            REGISTRY[n["kind"]].check(n["params"], complete=False)
            g.nodes[n["id"]] = Node(n["id"], n["kind"], dict(n["params"]), tuple(n["position"]))
        for e in data["edges"]:
            made = g.connect(e["source"], e["target"], e["input"], e["output"])
            del g.edges[made]
            g.edges[e["id"]] = Edge(**e)
        g.given = {letter: max(data["given"][letter], *(int(i[1:]) for i in ids), 0) if ids else data["given"][letter] for letter, ids in (("n", g.nodes), ("e", g.edges))}
        return g


def _variable(node: str, output: str) -> str:
    return node if output == "out" else f"{node}_{output}"


def _tagged(node: str, p: Pipeline) -> Pipeline:
    """Errors of a plan carry the innermost node."""

    def plan(span: Span):
        try:
            return p.plan(span)
        except NodeError:
            raise
        except Exception as e:
            raise NodeError(node, str(e)) from e

    return Pipeline(like(plan, p), order=p.order, acausal=p.acausal)
