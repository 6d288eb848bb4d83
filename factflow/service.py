"""Workspaces over HTTP and over JSON-RPC lines (the tools of a Model Context Protocol server).

One table says what each operation is called, what it takes and where it lies in HTTP; both ways of asking go through it.
Answers are rows that a query found, as JSON. The registry is in memory: workspaces are analysed again, from the tables
that are there, when they are created under the same root and project.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from factflow.workspace import NotFound, Workspace

#: Seconds without a request after which a loaded workspace is idle.
IDLE_AFTER = 10_800.0


@dataclass
class Entry:
    """A registered workspace, as it is shown."""

    id: str
    name: str
    project_path: str
    status: str  # loaded, idle or unloaded


class Manager:
    """Registered workspaces below one root folder. Idle ones load again when they are asked, unloaded ones do not."""

    def __init__(self, spark: SparkSession, root: str, idle_after: float = IDLE_AFTER, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.idle_after, self.clock = spark, root.rstrip("/"), idle_after, clock
        self._entries: dict[str, Entry] = {}
        self._open: dict[str, Workspace] = {}
        self._touched: dict[str, float] = {}
        self._lock = threading.Lock()

    def create(self, name: str, project_path: str) -> Entry:
        if not name.strip() or not project_path.strip():
            raise ValueError("name and project_path must not be empty")
        made = Entry(uuid.uuid4().hex, name, project_path, "loaded")
        workspace = Workspace(self.spark, f"{self.root}/{made.id}", project_path)
        workspace.analyze()
        with self._lock:
            self._entries[made.id], self._open[made.id], self._touched[made.id] = made, workspace, self.clock()
        return made

    def list(self) -> list[Entry]:
        with self._lock:
            for key in self._entries:
                self._age(key)
            return list(self._entries.values())

    def delete(self, key: str) -> bool:
        with self._lock:
            found = self._entries.pop(key, None)
            workspace = self._open.pop(key, None)
            self._touched.pop(key, None)
        if workspace is not None:
            workspace.remove()
        return found is not None

    def start(self, key: str) -> Entry:
        return self._set(key, "loaded")

    def stop(self, key: str) -> Entry:
        return self._set(key, "unloaded")

    def use(self, key: str) -> Workspace:
        with self._lock:
            entry = self._found(key)
            self._age(key)
            if entry.status == "unloaded":
                raise NotFound(f"workspace {key} is not loaded")
            entry.status, self._touched[key] = "loaded", self.clock()
            return self._open[key]

    def _set(self, key: str, status: str) -> Entry:
        with self._lock:
            entry = self._found(key)
            entry.status, self._touched[key] = status, self.clock()
            return entry

    def _found(self, key: str) -> Entry:
        if key not in self._entries:
            raise NotFound(f"workspace {key} not found")
        return self._entries[key]

    def _age(self, key: str) -> None:
        if self._entries[key].status == "loaded" and self.clock() - self._touched[key] > self.idle_after:
            self._entries[key].status = "idle"


def call_graph(manager: Manager, workspace_id: str, method: str, direction: str) -> dict:
    found = manager.use(workspace_id).call_graph(method, direction)
    return {"edges": [{"caller": r.caller, "callee": r.callee, "is_virtual": bool(r.is_virtual)} for r in found.orderBy("caller", "callee", "is_virtual").collect()]}


def lineage(manager: Manager, workspace_id: str, node: str, direction: str) -> dict:
    nodes, edges = manager.use(workspace_id).lineage(node, direction)
    rows = edges.orderBy("from_node", "to_node", "edge_type").collect()
    return {"nodes": sorted(r.name for r in nodes.select("name").distinct().collect()), "edges": [{"from": r.from_node, "to": r.to_node, "type": r.edge_type} for r in rows]}


def routes(manager: Manager, workspace_id: str, path: str | None = None, http_method: str | None = None) -> dict:
    found = manager.use(workspace_id).routes(path, http_method)
    return {"routes": [r.asDict() for r in found.orderBy("path", "http_method", "controller_method_fqn").collect()]}


@dataclass
class Operation:
    tool: str
    about: str
    verb: str
    path: str  # `{x}` is an argument
    run: Callable[..., object]
    needed: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    choices: dict[str, list[str]] | None = None

    def tool_entry(self) -> dict:
        kind = lambda a: {"type": "string", **({"enum": self.choices[a]} if self.choices and a in self.choices else {})}
        schema: dict = {"type": "object", "properties": {a: kind(a) for a in self.needed + self.optional}}
        return {"name": self.tool, "description": self.about, "inputSchema": schema | ({"required": list(self.needed)} if self.needed else {})}

    def call(self, manager: Manager, given: dict) -> object:
        for a in self.needed:
            if not isinstance(given.get(a), str):
                raise ValueError(f"Missing required parameter: {a}")
        out = self.run(manager, **{a: given[a] for a in self.needed + self.optional if given.get(a) is not None})
        return [asdict(e) for e in out] if isinstance(out, list) else asdict(out) if isinstance(out, Entry) else out


# Names of tools, arguments and paths.
OPERATIONS = [
    Operation("workspace_create", "Register a project and analyse it", "POST", "/api/workspaces", Manager.create, ("name", "project_path")),
    Operation("workspace_list", "List registered workspaces", "GET", "/api/workspaces", Manager.list),
    Operation("workspace_delete", "Remove a workspace and its tables", "DELETE", "/api/workspaces/{id}", lambda m, id: {"success": m.delete(id)}, ("id",)),
    Operation("workspace_start", "Load a workspace", "POST", "/api/workspaces/{id}/start", lambda m, id: m.start(id), ("id",)),
    Operation("workspace_stop", "Unload a workspace", "POST", "/api/workspaces/{id}/stop", lambda m, id: m.stop(id), ("id",)),
    Operation("query_call_graph", "Callers or callees of a method", "GET", "/api/workspaces/{workspace_id}/call-graph", call_graph, ("workspace_id", "method", "direction"), choices={"direction": ["incoming", "outgoing"]}),
    Operation("query_lineage", "What a node's data comes from or goes to", "GET", "/api/workspaces/{workspace_id}/lineage", lineage, ("workspace_id", "node", "direction"), choices={"direction": ["upstream", "downstream"]}),
    Operation("query_routes", "HTTP routes of a workspace", "GET", "/api/workspaces/{workspace_id}/routes", routes, ("workspace_id",), ("path", "http_method")),
]


def handle_http(manager: Manager, verb: str, target: str, body: bytes = b"") -> tuple[int, str, object]:
    """Status, content type and answer of a request. What the caller can mend (unknown, invalid, empty) is 400, else 500."""
    parts = urlsplit(target)
    if (verb, parts.path) == ("GET", "/health"):
        return 200, "text/plain", "OK"
    for op in OPERATIONS:
        m = re.fullmatch(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", op.path), parts.path)
        if m and verb == op.verb:
            try:
                sent = json.loads(body) if body else {}
                if not isinstance(sent, dict):
                    raise ValueError("Invalid body")
                return 200, "application/json", op.call(manager, sent | dict(parse_qsl(parts.query)) | m.groupdict())
            except ValueError as e:
                return 400, "application/json", {"error": str(e)}
            except Exception as e:  # noqa: BLE001: a server answers whatever goes wrong
                return 500, "application/json", {"error": str(e)}
    return 404, "application/json", {"error": f"{verb} {parts.path} not found"}


def http_server(manager: Manager, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for `serve_forever`; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, kind, out = handle_http(manager, self.command, self.path, self.rfile.read(size))
            raw = (out if isinstance(out, str) else json.dumps(out)).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = answer  # noqa: N815

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def handle_line(manager: Manager, line: str) -> dict | None:
    """The answer to one JSON-RPC line; None for a notification, which has no id."""
    try:
        asked = json.loads(line)
        method = asked["method"]
    except (ValueError, KeyError, TypeError) as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"Parse error: {e}"}}
    result = error = None
    if method == "initialize":
        result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "factflow", "version": "0.1.0"}}
    elif method == "tools/list":
        result = {"tools": [op.tool_entry() for op in OPERATIONS]}
    elif method == "tools/call":
        params = asked.get("params")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            error = (-32602, "Missing parameters" if not isinstance(params, dict) else "Missing tool name")
        else:
            try:
                op = next((o for o in OPERATIONS if o.tool == params["name"]), None)
                if op is None:
                    raise ValueError(f"Unknown tool: {params['name']}")
                result = {"content": [{"type": "text", "text": json.dumps(op.call(manager, params.get("arguments") or {}))}]}
            except Exception as e:  # noqa: BLE001: a server answers whatever goes wrong
                error = (-32603, str(e))
    else:
        error = (-32601, f"Method not found: {method}")
    if asked.get("id") is None:
        return None
    out = {"jsonrpc": "2.0", "id": asked["id"]}
    return out | ({"error": {"code": error[0], "message": error[1]}} if error else {"result": result})


def serve_lines(manager: Manager, lines, write: Callable[[str], object]) -> None:
    """Answer line by line, until the lines end: `serve_lines(manager, sys.stdin, print)`."""
    for line in lines:
        if line.strip() and (out := handle_line(manager, line)) is not None:
            write(json.dumps(out))
