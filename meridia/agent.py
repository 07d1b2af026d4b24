"""A session's tools for an agent, by the Model Context Protocol's JSON-RPC messages.

Results are summaries, never rows.  ``Agent.handle`` answers one message; ``serve`` answers lines of a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, TextIO

from meridia.commands import COMMANDS, Commands, ask, plain

VERSION = "2025-06-18"
#: Tool -> command; the arguments are the command's.
TOOLS = {
    "list_node_kinds": "node_kinds", "get_graph": "graph", "add_node": "add_node", "update_node": "update_node", "remove_node": "remove_node", "connect": "connect",
    "disconnect": "disconnect", "set_context": "set_context", "remove_context": "remove_context", "load_table": "load_table", "run": "run", "get_result_summary": "summary",
    "get_diagnostic": "diagnostic", "fit_insample": "fit_insample", "export_script": "export", "save": "save", "open": "open",
}


class Agent:
    def __init__(self, commands: Commands, url: Callable[[], str] | None = None):
        self.commands, self.url = commands, url

    def tools(self) -> list[dict]:
        out = [{"name": t, "description": COMMANDS[c].doc, "inputSchema": COMMANDS[c].schema(), "annotations": {"readOnlyHint": COMMANDS[c].readonly}} for t, c in TOOLS.items()]
        if self.url is not None:
            out.append({"name": "get_web_url", "description": "Where a person opens this session.", "inputSchema": {"type": "object", "properties": {}}, "annotations": {"readOnlyHint": True}})
        return out

    def call(self, tool: str, args: dict | None = None) -> Any:
        if tool == "get_web_url" and self.url is not None:
            return {"url": self.url()}
        if tool not in TOOLS:
            raise KeyError(f"no tool {tool}")
        args = dict(args or {})
        if tool == "get_diagnostic":
            COMMANDS["diagnostic"].check(args)
            return self.commands.diagnostic(**args, data=False)
        return ask(self.commands, TOOLS[tool], args)

    def handle(self, message: dict) -> dict | None:
        """The answer to a request; None to a notification."""
        method, params = message.get("method"), message.get("params") or {}
        if "id" not in message:
            return None
        answer = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "meridia", "version": "1"}}}
        if method == "ping":
            return answer | {"result": {}}
        if method == "tools/list":
            return answer | {"result": {"tools": self.tools()}}
        if method == "tools/call":
            try:
                text, failed = json.dumps(plain(self.call(params.get("name", ""), params.get("arguments")))), False
            except Exception as error:  # a tool's failure is its answer
                text, failed = str(error.args[0]) if error.args else str(error), True
            return answer | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
        return answer | {"error": {"code": -32601, "message": f"no method {method}"}}

    def serve(self, lines: TextIO, out: TextIO) -> None:
        for line in lines:
            if line.strip() and (answer := self.handle(json.loads(line))) is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()
