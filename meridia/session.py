"""Sessions: a graph with contexts, tables, a SQL prelude, runs in the background, kept results, and files.

Runs keep results by ``persist`` and so recompute from their lineage what a lost executor held.  The cache is
bounded by the planner's size estimate of each kept result and gives up the least recently used first.
"""

from __future__ import annotations

import hashlib
import json
import queue
import threading
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from meridia import sources as src
from meridia.functions import diagnostics as D
from meridia.graph import Env, Graph, NodeError
from meridia.pipeline import TIME, Pipeline, like
from meridia.span import Span

FORMAT, VERSION = "causal-graph-session", 1
MAIN = "analysis"
DIAGNOSTICS = {
    "acf": D.acf, "pacf": D.pacf, "ljungbox": D.ljung_box, "adf": D.adf, "histogram": D.histogram, "qqplot": D.qqplot,
    "series": D.series, "residuals": D.residual_panel,
}


class Canceled(RuntimeError):
    pass


@dataclass
class Event:
    seq: int
    kind: str
    origin: str
    data: dict


@dataclass
class Kept:
    df: DataFrame
    size: int
    frozen: bool = False


@dataclass
class Run:
    """A run in the background; :meth:`result` waits for it."""

    targets: tuple[tuple[str, str], ...]
    context: Span
    tag: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex}")
    canceled: bool = False
    error: BaseException | None = None
    frames: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    thread: threading.Thread | None = None

    def result(self, timeout: float | None = None) -> dict[tuple[str, str], DataFrame]:
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError("the run goes on")
        if self.error is not None:
            raise self.error
        return self.frames


class Session:
    def __init__(self, spark: SparkSession, start: Any, stop: Any, budget: int = 1 << 30, models: dict[str, Any] | None = None):
        self.spark, self.budget = spark, budget
        self.graph = Graph()
        self.contexts: dict[str, Span] = {MAIN: Span(start, stop)}
        self.tables: dict[str, src.Table] = {}
        self.models: dict[str, Any] = dict(models or {})
        self.prelude: list[str] = []
        self.status: dict[str, str] = {}
        self.errors: dict[str, str] = {}
        self._kept: OrderedDict[tuple, Kept] = OrderedDict()
        self._lock = threading.RLock()
        self._current: Run | None = None
        self._queues: list[tuple[queue.Queue, list[int]]] = []
        self._seq = 0

    # Events

    def subscribe(self, size: int = 256) -> tuple[queue.Queue, list[int]]:
        """A bounded queue that never blocks a run, and the count of the events that it had no room for."""
        entry = (queue.Queue(size), [0])
        with self._lock:
            self._queues.append(entry)
        return entry

    def _publish(self, kind: str, origin: str = "session", **data: Any) -> None:
        with self._lock:
            self._seq += 1
            for q, dropped in self._queues:
                try:
                    q.put_nowait(Event(self._seq, kind, origin, data))
                except queue.Full:
                    dropped[0] += 1

    # Edits

    def _env(self) -> Env:
        return Env(self.spark, self.tables, self.contexts, self.models)

    def _invalidate(self, *nodes: str) -> None:
        stale = {n for node in nodes for n in (node, *(self.graph.descendants(node) if node in self.graph.nodes else ()))}
        for key in [k for k in self._kept if k[0] in stale]:
            self._kept.pop(key).df.unpersist()
        for n in stale:
            self.errors.pop(n, None)
            if n in self.graph.nodes:
                self.status[n] = "idle"
            else:
                self.status.pop(n, None)
        self._publish("invalidated", nodes=sorted(stale))

    def add_node(self, kind: str, params: dict | None = None, position=(0.0, 0.0)) -> str:
        with self._lock:
            node = self.graph.add(kind, params, position)
            self.status[node] = "idle"
            self._publish("added", node=node)
            return node

    def set_params(self, node: str, params: dict) -> None:
        with self._lock:
            self.graph.set_params(node, params)
            self._invalidate(node)

    def set_position(self, node: str, x: float, y: float) -> None:
        with self._lock:
            self.graph.set_position(node, x, y)

    def remove_node(self, node: str) -> None:
        with self._lock:
            below = self.graph.descendants(node)
            self.graph.remove(node)
            self._invalidate(node, *below)

    def connect(self, source: str, target: str, input: str = "in", output: str | None = None) -> str:
        with self._lock:
            edge = self.graph.connect(source, target, input, output)
            self._invalidate(target)
            return edge

    def disconnect(self, edge: str) -> None:
        with self._lock:
            self._invalidate(self.graph.disconnect(edge).target)

    def set_context(self, name: str, start: Any, stop: Any) -> None:
        with self._lock:
            self.contexts[name] = Span(start, stop)
            self._invalidate(*[n for n, node in self.graph.nodes.items() if name in (node.params.get("context"), node.params.get("fitcontext"))])

    def remove_context(self, name: str) -> None:
        with self._lock:
            if name == MAIN:
                raise ValueError(f"the context {MAIN} stays")
            del self.contexts[name]

    def add_table(self, name: str, df: DataFrame, time: str | None = TIME, order: tuple[str, ...] = (), within: Span | None = None) -> None:
        """``time=None``: a table that is only looked up."""
        with self._lock:
            self.tables[name] = src.Table(df, time, tuple(order), within=within)
            self._invalidate(*[n for n, node in self.graph.nodes.items() if node.params.get("table") == name])

    def load_table(self, name: str, path: str, time: str | None = TIME) -> None:
        self.add_table(name, src.load_table(self.spark, path), time)

    def set_prelude(self, statements: list[str]) -> None:
        """``CREATE OR REPLACE TEMPORARY FUNCTION`` statements; when one fails, the old prelude is set again."""
        with self._lock:
            try:
                for s in statements:
                    self.spark.sql(s)
            except Exception:
                for s in self.prelude:
                    self.spark.sql(s)
                raise
            self.prelude = list(statements)
            self._invalidate(*self.graph.nodes)

    # Plans and kept results

    def _fingerprint(self, node: str) -> str:
        """Of everything upstream that decides the result; positions don't."""
        needed = self.graph.ancestors(node) | {node}
        parts = [[n, self.graph.nodes[n].kind, self.graph.nodes[n].params] for n in sorted(needed)]
        edges = [[e.source, e.output, e.target, e.input] for e in self.graph.edges.values() if e.target in needed]
        return hashlib.sha256(json.dumps([parts, edges], sort_keys=True, default=str).encode()).hexdigest()

    def _key(self, node: str, output: str, span: Span) -> tuple:
        return (node, output, self._fingerprint(node), span)

    def pipeline(self, node: str, output: str | None = None) -> Pipeline:
        """The plan of an output; a kept result serves the equal context and no other."""

        def wrap(n: str, o: str, p: Pipeline) -> Pipeline:
            def plan(span: Span) -> DataFrame:
                with self._lock:
                    key = self._key(n, o, span)
                    if key in self._kept:
                        self._kept.move_to_end(key)
                        return self._kept[key].df
                return p.plan(span)

            return Pipeline(like(plan, p), order=p.order, acausal=p.acausal)

        with self._lock:
            return self.graph.compile(self._env(), node, output, wrap)

    def _keep(self, key: tuple, df: DataFrame, frozen: bool = False) -> None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        old = self._kept.pop(key, None)
        self._kept[key] = Kept(df, size, frozen or (old is not None and old.frozen))
        while sum(k.size for k in self._kept.values() if not k.frozen) > self.budget:
            victim = next((k for k, v in self._kept.items() if not v.frozen and k != key), None)
            if victim is None:
                return
            self._kept.pop(victim).df.unpersist()

    @property
    def kept_bytes(self) -> int:
        return sum(k.size for k in self._kept.values())

    # Runs

    def run(self, *targets: str | tuple[str, str], context: str | Span = MAIN) -> Run:
        """Start a run; one under way is canceled and keeps nothing.  Nodes that write don't write here."""
        with self._lock:
            self.cancel()
            span = context if isinstance(context, Span) else self.contexts[context]
            pairs = tuple((t, self.graph.kind(t).outputs[0]) if isinstance(t, str) else tuple(t) for t in targets)
            run = Run(pairs, span)
            self._current = run
            for n, _ in pairs:
                self.status[n] = "running"
            run.thread = InheritableThread(target=self._execute, args=(run,), session=self.spark)
            run.thread.start()
            return run

    def cancel(self) -> None:
        with self._lock:
            run, self._current = self._current, None
            if run is not None and run.thread.is_alive():
                run.canceled = True
                self.spark.interruptTag(run.tag)
                for n, _ in run.targets:
                    self.status[n] = "idle"

    def _execute(self, run: Run) -> None:
        self.spark.addTag(run.tag)
        try:
            for node, output in run.targets:
                self._publish("started", node, output=output)
                df = self._materialized(run, node, output)
                with self._lock:
                    if run.canceled:
                        df.unpersist()
                        raise Canceled("another run took over")
                    self._keep(self._key(node, output, run.context), df)
                    self.status[node] = "ok"
                    self.errors.pop(node, None)
                run.frames[node, output] = df
                self._publish("finished", node, output=output)
        except BaseException as error:
            run.error = Canceled("the run was canceled") if run.canceled else error
            if not run.canceled:
                self._record(run, error)
        finally:
            self.spark.removeTag(run.tag)

    def _materialized(self, run: Run, node: str, output: str) -> DataFrame:
        df = self.pipeline(node, output).plan(run.context)
        if df.storageLevel != StorageLevel.NONE:
            return df
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            df.write.format("noop").mode("overwrite").save()
        except Exception as error:
            df.unpersist()
            if run.canceled:
                raise
            raise NodeError(self._culprit(node, output, run.context) or node, str(error)) from error
        return df

    def _culprit(self, node: str, output: str, span: Span) -> str | None:
        """The first node upstream, sources first, whose own result fails."""
        needed = self.graph.ancestors(node) | {node}
        for n in self.graph.topological():
            if n in needed:
                for o in self.graph.kind(n).outputs:
                    if n == node and o != output:
                        continue
                    try:
                        self.pipeline(n, o).plan(span).write.format("noop").mode("overwrite").save()
                    except Exception:
                        return n
        return None

    def _record(self, run: Run, error: BaseException) -> None:
        """The innermost node has the error; the targets below it and what lies between are blocked."""
        with self._lock:
            source = error.node if isinstance(error, NodeError) else None
            for node, output in run.targets:
                if (node, output) in run.frames:
                    continue
                self.status[node] = "error" if source in (None, node) else "idle"
                if source is not None and source in self.graph.ancestors(node):
                    for n in (self.graph.ancestors(node) | {node}) & self.graph.descendants(source):
                        self.status[n] = "blocked"
            at = source or run.targets[-1][0]
            self.status[at], self.errors[at] = "error", str(error)
            self._publish("failed", at, message=str(error))

    def load(self, node: str, output: str | None = None, context: str | Span = MAIN) -> DataFrame:
        """The lazy result; nothing is run or kept."""
        return self.pipeline(node, output).load(context if isinstance(context, Span) else self.contexts[context])

    def freeze(self, node: str, name: str, folder: str, output: str | None = None, context: str | Span = MAIN) -> str:
        """Write a result as a table that refuses wider windows; a node of kind ``table`` reads it."""
        span = context if isinstance(context, Span) else self.contexts[context]
        p = self.pipeline(node, output)
        src.save_table(p.load(span).drop("_part"), folder, name, span)
        frozen, within = src.read_snapshot(self.spark, folder, name)
        self.add_table(name, frozen, order=tuple(o for o in p.order if o != "_part"), within=within)
        return self.add_node("table", {"table": name})

    def write(self, node: str, context: str | Span = MAIN, mode: str = "errorifexists") -> None:
        """The only way that a writing node writes."""
        with self._lock:
            self.graph.ready(node)
            kind, params = self.graph.kind(node), self.graph.nodes[node].params
            if not kind.name.startswith("write"):
                raise ValueError(f"{node} doesn't write")
            edge = self.graph.in_edges(node)[0]
            source = self.pipeline(edge.source, edge.output)
        kind.call(params["path"]).write(source, context if isinstance(context, Span) else self.contexts[context], mode)

    def diagnostic(self, node: str, kind: str, column: str, output: str | None = None, context: str | Span = MAIN, key: str | None = None, **options: Any) -> D.DiagnosticResult:
        """An analysis of a result; degrees of freedom and the fit's stop come from the fits upstream."""
        if kind not in DIAGNOSTICS:
            raise ValueError(f"a diagnostic is one of {', '.join(DIAGNOSTICS)}")
        p = self.pipeline(node, output)
        df = D.keyed(p.load(context if isinstance(context, Span) else self.contexts[context]), key)
        if kind in ("ljungbox", "residuals"):
            for name, value in self._fit_facts(node).items():
                if name == "dof" or kind == "residuals":
                    options.setdefault(name, value)
        return DIAGNOSTICS[kind](p, df, column, **options)

    def _fit_facts(self, node: str) -> dict:
        out = {}
        for n in [m for m in self.graph.topological() if m in self.graph.ancestors(node) | {node}]:
            kind, params = self.graph.kind(n), self.graph.nodes[n].params
            if kind.name in ("fit", "fitarma", "arma") and params.get("family", "arma") == "arma":
                order, seasonal = params.get("order") or (1, 0, 0), params.get("seasonal_order") or (0, 0, 0, 0)
                out["dof"] = order[0] + order[2] + seasonal[0] + seasonal[2]
            elif kind.name == "fit" and params.get("family") == "ar":
                out["dof"] = params["p"]
            context = params.get("fitcontext") or params.get("context")
            if context in self.contexts:
                out["fitstop"] = self.contexts[context].stop
        return out

    # Files

    def export(self, node: str, output: str | None = None, context: str = MAIN) -> str:
        """A script with ``build(spark, TABLES, MODELS)`` that gives the same frame; only what the target needs."""
        with self._lock:
            spans = {n: s for n, s in self.contexts.items()}
            lines = [
                "from datetime import date, datetime, timedelta  # noqa: F401", "",
                "from meridia import sources  # noqa: F401", "from meridia.functions import summarizers as S  # noqa: F401",
                "from meridia.operators import joins, rows, summarize, timeseries  # noqa: F401", "from meridia.span import Span", "",
                "CONTEXTS = {" + ", ".join(f"{n!r}: Span({_source(s.start)}, {_source(s.stop)})" for n, s in spans.items()) + "}",
                f"PRELUDE = {self.prelude!r}", "", "",
                f"def build(spark, TABLES, MODELS=None, context={context!r}):",
                "    for statement in PRELUDE:", "        spark.sql(statement)",
                *[f"    {line}" for line in self.graph.script(node, output)],
                "    return result.load(CONTEXTS[context])", "",
            ]
            return "\n".join(lines)

    def save(self, folder: str) -> None:
        """The graph as JSON and the tables as Parquet under ``folder``; model objects stay with the program."""
        with self._lock:
            saved = {}
            for name, t in self.tables.items():
                src.save_table(t.df, f"{folder}/tables", name, t.within)
                saved[name] = {"time": t.time, "order": list(t.order), "closed": t.closed}
            data = {
                "format": FORMAT, "version": VERSION, "graph": self.graph.to_dict(), "prelude": self.prelude, "tables": saved,
                "contexts": {n: [src.encode_time(s.start), src.encode_time(s.stop)] for n, s in self.contexts.items()},
            }
            self.spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/session")

    def open(self, folder: str) -> None:
        """Read a saved session in place of this one; a file that can't be read leaves this one alone."""
        data = json.loads("".join(r["value"] for r in self.spark.read.text(f"{folder}/session").collect()))  # one row
        if data.get("format") != FORMAT or data.get("version") != VERSION:
            raise ValueError("not a session of this format and version")
        graph = Graph.from_dict(data["graph"])
        contexts = {n: Span(*map(src.decode_time, s)) for n, s in data["contexts"].items()}
        if MAIN not in contexts:
            raise ValueError(f"the file has no context {MAIN}")
        tables = {}
        for name, t in data["tables"].items():
            df, within = src.read_snapshot(self.spark, f"{folder}/tables", name)
            tables[name] = src.Table(df, t["time"], tuple(t["order"]), t["closed"], within)
        with self._lock:
            self.set_prelude(data["prelude"])
            self.cancel()
            for kept in self._kept.values():
                kept.df.unpersist()
            self._kept.clear()
            self.graph, self.contexts, self.tables = graph, contexts, tables
            self.status, self.errors = dict.fromkeys(graph.nodes, "idle"), {}
            self._publish("opened")


def _source(value: Any) -> str:
    """A time as Python source."""
    return repr(value).removeprefix("datetime.")
