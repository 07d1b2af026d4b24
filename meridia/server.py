"""A session over HTTP: JSON routes on the loopback interface, behind a token.

Every request shows the token (a bearer header, or the cookie that ``/api/auth`` sets); requests that name another host,
or come from a page of another origin, are refused.
"""

from __future__ import annotations

import json
import re
import secrets
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from meridia.agent import Agent
from meridia.commands import Commands, ask, plain
from meridia.graph import NodeError, ParameterError
from meridia.session import Session

COOKIE = "session_token"
MOST_BYTES = 16 << 20
#: (method, path with names of arguments) -> command
ROUTES = {
    ("GET", "/api/nodekinds"): "node_kinds", ("GET", "/api/graph"): "graph",
    ("POST", "/api/nodes"): "add_node", ("PATCH", "/api/nodes/{id}"): "update_node", ("DELETE", "/api/nodes/{id}"): "remove_node", ("POST", "/api/nodes/{id}/freeze"): "freeze",
    ("POST", "/api/edges"): "connect", ("DELETE", "/api/edges/{id}"): "disconnect",
    ("GET", "/api/contexts"): "contexts", ("PUT", "/api/contexts/{name}"): "set_context", ("DELETE", "/api/contexts/{name}"): "remove_context",
    ("GET", "/api/tables"): "tables", ("POST", "/api/tables/{name}"): "load_table", ("PUT", "/api/prelude"): "set_prelude",
    ("POST", "/api/run"): "start", ("POST", "/api/cancel"): "cancel", ("POST", "/api/write/{id}"): "write",
    ("GET", "/api/results/{node}/{port}"): "result", ("GET", "/api/summaries/{node}/{port}"): "summary", ("GET", "/api/diagnostics/{node}/{port}/{kind}"): "diagnostic",
    ("GET", "/api/export/{node}"): "export", ("GET", "/api/session"): "session_file", ("PUT", "/api/session"): "save", ("POST", "/api/session"): "open", ("GET", "/api/files"): "files",
}
_PATTERNS = [(m, re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + r"\Z"), command) for (m, path), command in ROUTES.items()]
_STATUS = {KeyError: 404, LookupError: 409, PermissionError: 403, FileNotFoundError: 404, ParameterError: 400, ValueError: 400, TypeError: 400, NodeError: 422}


def _typed(text: str) -> Any:
    """A query's value: JSON where it is (numbers, lists, true), else text."""
    try:
        return json.loads(text)
    except ValueError:
        return text.split(",") if "," in text else text


class Server:
    """``start`` serves in the background until ``stop``; ``url`` carries the token."""

    def __init__(self, session: Session, folder: str = ".", port: int = 0, token: str | None = None):
        self.commands, self.token = Commands(session, folder), token or secrets.token_hex(32)
        self.agent = Agent(self.commands, lambda: self.url)
        self._queue, self._dropped = session.subscribe()
        server = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def __getattr__(self, name):
                if name.startswith("do_"):
                    return lambda: server._answer(self)
                raise AttributeError(name)

        self._http = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self._http.server_address[1]
        self.url = f"http://127.0.0.1:{self.port}/?token={self.token}"

    def start(self) -> Server:
        threading.Thread(target=self._http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self._http.shutdown()
        self._http.server_close()

    # One request

    def _refused(self, request: BaseHTTPRequestHandler, query: dict) -> tuple[int, str] | None:
        hosts = {f"{h}:{self.port}" for h in ("127.0.0.1", "localhost")}
        if request.headers.get("Host") not in hosts:
            return 403, "another host"
        origin = request.headers.get("Origin")
        if origin and urlsplit(origin).netloc not in hosts:
            return 403, "another origin"
        cookies = dict(c.strip().split("=", 1) for c in request.headers.get("Cookie", "").split(";") if "=" in c)
        bearer = request.headers.get("Authorization", "")
        shown = bearer.removeprefix("Bearer ").strip() if bearer.startswith("Bearer ") else cookies.get(COOKIE) or query.pop("token", None)
        query.pop("token", None)
        if not shown or not secrets.compare_digest(shown.encode(), self.token.encode()):
            return 401, "the token is missing or wrong"
        return None

    def _answer(self, request: BaseHTTPRequestHandler) -> None:
        parts = urlsplit(request.path)
        query = {k: v if k == "token" else _typed(v) for k, v in parse_qsl(parts.query)}
        size = int(request.headers.get("Content-Length") or 0)
        headers = {}
        if size > MOST_BYTES:
            status, body = 413, {"error": "the request is too long"}
        elif refused := self._refused(request, query):
            status, body = refused[0], {"error": refused[1]}
        elif parts.path == "/api/auth":
            status, body, headers = 200, {"ok": True}, {"Set-Cookie": f"{COOKIE}={self.token}; HttpOnly; SameSite=Strict; Path=/"}
        else:
            status, body = self._dispatch(request.command, unquote(parts.path), query, request.rfile.read(size) if size else b"")
        raw = json.dumps(plain(body)).encode()
        request.send_response(status)
        for name, value in {"Content-Type": "application/json", "Content-Length": str(len(raw)), "Cache-Control": "no-store", **headers}.items():
            request.send_header(name, value)
        request.end_headers()
        request.wfile.write(raw)

    def _dispatch(self, method: str, path: str, query: dict, raw: bytes) -> tuple[int, Any]:
        try:
            body = json.loads(raw) if raw else {}
            if path == "/api/agent" and method == "POST":
                return 200, self.agent.handle(body)
            if path == "/api/events" and method == "GET":
                return 200, self._events()
            known = [(m, found, command) for m, pattern, command in _PATTERNS if (found := pattern.match(path))]
            if not known:
                return 404, {"error": "no such route"}
            for m, found, command in known:
                if m == method:
                    if not isinstance(body, dict):
                        raise ValueError("a request's body is an object")
                    return 200, ask(self.commands, command, query | body | found.groupdict())
            return 405, {"error": f"not by {method}"}
        except Exception as error:
            status = next((s for kind, s in _STATUS.items() if type(error) is kind), None) or next((s for kind, s in _STATUS.items() if isinstance(error, kind)), 500)
            return status, {"error": str(error.args[0]) if error.args else str(error)}

    def _events(self) -> dict:
        """What happened since the last call, and how many events found no room."""
        out = []
        while not self._queue.empty():
            e = self._queue.get()
            out.append({"seq": e.seq, "kind": e.kind, "origin": e.origin, "data": e.data})
        return {"events": out, "dropped": self._dropped[0]}
